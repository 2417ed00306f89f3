"""TIFF columns: files of 8-bit samples, read page by page.

The reader walks the chain of image directories in either byte order, decodes strips and tiles
(none, PackBits, LZW, deflate), undoes horizontal differencing and gives one row per page. The
writer stores bytes losslessly as a grey page per block, in strips or tiles. A page that can't be
decoded gives a row with its error and null samples, and the rows of the other pages; a null or
empty file gives no rows. Repeated files give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, raw_texts

# Fixed values of the format: tags, field sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER = 266
STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Row width of stored payloads, and rows of a page and of a strip.
ROW, PAGE_ROWS, STRIP = 192, 4096, 512
#: How files are stored: strips and tiles of each compression, either byte order.
FORMS = [
    {"compression": DEFLATE, "predictor": 2},
    {"compression": LZW, "predictor": 1, "strip": 64},
    {"compression": PACKBITS, "predictor": 1, "tile": (64, 64), "order": ">"},
    {"compression": DEFLATE, "predictor": 2, "tile": (128, 96)},
    {"compression": LZW, "predictor": 2, "tile": (32, 192), "order": ">"},
]
PAGES = "id long, page int, width int, height int, channels int, compression int, samples binary, error string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 2
            else:
                i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more, and what lies between them, in pieces of at most 128."""
    out, at = bytearray(), 0
    for start, end in [*(m.span() for m in _RUN.finditer(data)), (len(data), len(data))]:
        for i in range(at, start, 128):
            piece = data[i : min(i + 128, start)]
            out.append(len(piece) - 1)
            out += piece
        if end > start:
            out += bytes((257 - (end - start), data[start]))
        at = end
    return bytes(out)


#: Bits of the k-th code after a clear code; from FULL codes on, tables stay as they are.
FULL = 4096
LZW_BITS = np.array([9] + [min(12, (258 + k).bit_length()) for k in range(1, FULL)])


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widening one code early."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, previous, at, k = list(start), [], b"", 0, 0
    while True:
        # the codes up to the next clear code have known widths
        width = LZW_BITS[k:] if k < FULL else np.full(FULL, 12)
        end = at + np.cumsum(width)
        n = int(np.searchsorted(end, len(bits), side="right"))
        if not n:
            break
        place = end[:n, None] - 12 + np.arange(12)
        codes = np.where(np.arange(12) >= 12 - width[:n, None], bits[np.maximum(place, 0)], 0) @ (1 << np.arange(11, -1, -1))
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        for code in codes[: stop[0] if len(stop) else n].tolist():
            if code < len(table):
                entry = table[code]
                if previous:
                    table.append(previous + entry[:1])
            elif code == len(table) and previous:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            previous = entry
        if not len(stop):
            at, k = int(end[n - 1]), k + n
            continue
        if codes[stop[0]] == 257:
            break
        table, previous, at, k = list(start), b"", int(end[stop[0]]), 0
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """A clear code first and whenever the table is full; strings are known by the code of all but their last byte."""
    codes, first = [256], []  # codes, and which of them begin a table
    emit, table, free, word = codes.append, {}, 258, -1
    first.append(1)
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        known = table.get(key)
        if known is not None:
            word = known
            continue
        emit(word)
        table[key] = free
        free += 1
        word = byte
        if free >= 4094:
            emit(word)
            emit(256)
            first.append(len(codes))
            table, free, word = {}, 258, -1
    if word >= 0:
        emit(word)
    emit(257)
    values = np.array(codes)
    since = np.arange(len(values)) - np.array([0, *first])[np.searchsorted(first, np.arange(len(values)), side="right")]
    width = LZW_BITS[np.minimum(since, FULL - 1)]
    width[0] = 9
    shown = np.arange(12) >= 12 - width[:, None]
    return np.packbits((values[:, None] >> np.arange(11, -1, -1) & 1).astype(np.uint8)[shown]).tobytes()


DECODE = {NONE: bytes, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        fields = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                fields[tag] = struct.unpack_from(form, data, place)
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def samples(data: bytes, f: dict[int, tuple]) -> np.ndarray:
    """A page as height x width x channels."""
    width, height = f[WIDTH][0], f[HEIGHT][0]
    channels = f.get(SAMPLES, (1,))[0]
    if set(f.get(BITS, (1,))) != {8}:
        raise ValueError("samples are not of 8 bits")
    if f.get(284, (1,))[0] != 1:
        raise ValueError("planes are stored apart")
    if f.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"predictor {f[PREDICTOR][0]} is unknown")
    if f.get(FILL_ORDER, (1,))[0] != 1:
        raise ValueError("bits are stored low first")
    decode = DECODE.get(f.get(COMPRESSION, (NONE,))[0])
    if decode is None:
        raise ValueError(f"compression {f[COMPRESSION][0]} is unknown")
    tiled = TILES in f
    w, h = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(STRIP_ROWS, (height,))[0]))
    out = np.empty((height, width, channels), np.uint8)
    places = zip(f[TILES if tiled else STRIPS], f[TILE_BYTES if tiled else STRIP_BYTES], strict=True)
    across = -(-width // w)
    for k, (at, size) in enumerate(places):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        block = np.frombuffer(decode(data[at : at + size]), np.uint8, rows * w * channels).reshape(rows, w, channels)
        if f.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return out


def pages(data: bytes) -> Iterator[tuple[int, dict[int, tuple], np.ndarray]]:
    for k, f in enumerate(directories(data)):
        yield k, f, samples(data, f)


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip: int = STRIP, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of grey or interleaved pages; deterministic in its arguments."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, channels = image.shape
        h, w = tile or (min(strip, height), width)
        at, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                code = ENCODE[compression](np.ascontiguousarray(block).tobytes())
                at.append(len(out))
                sizes.append(len(code))
                out += code + b"\0" * (len(code) % 2)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * channels), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if channels >= 3 else 1]), SAMPLES: (3, [channels]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [w]), TILE_HEIGHT: (4, [h]), TILES: (4, at), TILE_BYTES: (4, sizes)} if tile else {STRIPS: (4, at), STRIP_ROWS: (4, [h]), STRIP_BYTES: (4, sizes)}
        entries = bytearray()
        for tag in sorted(fields):
            kind, values = fields[tag]
            packed = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(packed) > 4:
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place + b"\0" * (len(place) % 2)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + b"\0" * 4
    return bytes(out)


def tiff_pages(media: DataFrame, id_col: str = "id", bytes_col: str = "media") -> DataFrame:
    """One row per page: id, page, width, height, channels, compression, samples, error."""

    def read(batches):
        for batch in batches:
            rows = []
            for i, blob in zip(column(batch, "id").to_pylist(), column(batch, "media"), strict=True):
                blob = blob.as_py()
                if not blob:
                    continue
                page = -1
                try:
                    for page, f in enumerate(directories(blob)):
                        try:
                            s = samples(blob, f)
                            rows.append((i, page, s.shape[1], s.shape[0], s.shape[2], f.get(COMPRESSION, (NONE,))[0], s.tobytes(), None))
                        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                            rows.append((i, page, None, None, None, None, None, str(e)))
                except (ValueError, struct.error) as e:
                    rows.append((i, page + 1, None, None, None, None, None, str(e)))
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
            names = ["id", "page", "width", "height", "channels", "compression", "samples", "error"]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.selectExpr(f"cast({id_col} as long) as id", f"{bytes_col} as media").mapInArrow(read, PAGES)


def store(payload: np.ndarray) -> bytes:
    """Bytes, a multiple of ROW, as rows of grey pages, in one of FORMS by the bytes themselves."""
    grid = payload.reshape(-1, ROW)
    form = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write([grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)], **form)


def feature(payload: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, then shares of four value ranges."""
    counts = np.bincount(payload, minlength=256)
    share = counts / len(payload)
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    entropy = -float(np.sum(share[counts > 0] * np.log2(share[counts > 0])))
    ranges = share.reshape(4, 64).sum(1)
    return ",".join(f"{v:.4f}" for v in (mean, deviation, entropy, *ranges))


def store_and_read(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a TIFF file, read back page by page, and measured. Null: empty."""

    def run(batches):
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), raw_texts(column(batch, "text")), strict=True):
                pad = -len(text) % ROW or (0 if len(text) else ROW)
                media = store(np.concatenate([text, np.full(pad, 32, np.uint8)]))
                read = [s.ravel() for _, _, s in pages(media)]
                payload = np.concatenate(read)
                raw = payload.tobytes()
                rows.append((doc, len(text), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), len(read)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
