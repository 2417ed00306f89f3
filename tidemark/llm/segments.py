"""Anchored segments: a sparse index of all windows of a fixed length.

Each window of `length` symbols is represented by its anchor, the place of the least hash among
its grams of `gram` symbols (leftmost at ties). The anchor depends on the window alone, so equal
windows have equal anchors at equal offsets. Windows in a row with the same anchor form a segment;
about one symbol in (length - gram) / 2 begins one. Two windows are equal only if their anchors'
hashes are, and are if their segments are: whole segments settle most windows without a look at
the symbols. Nothing is sampled: each window lies in exactly one segment.

A segment's place is one long: start * 2^16 + windows * 2^8 + offset of the anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _C1, _C2, column, mix, range_hash, raw_texts

_BITS = 22
_MASK = np.uint64((1 << _BITS) - 1)
#: Windows looked at together; longer texts go in slices, whose segments end at the slice.
_SLICE = 1 << 21


def _slice(symbols: np.ndarray, valid: np.ndarray, length: int, gram: int):
    width = length - gram + 1
    place = np.arange(len(symbols) - gram + 1)
    h = range_hash(symbols, place, place + gram)
    least = (h & ~_MASK) | place.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & _MASK).astype(np.int64)
    begin = valid.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    start = np.flatnonzero(begin)
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    windows = np.flatnonzero(last) - start + 1
    anchor = at[start]
    offset = anchor - start
    whole = range_hash(symbols, start, start + windows + length - 1)
    whole = mix(whole + offset.astype(np.uint64) * _C1 + windows.astype(np.uint64) * _C2)
    return h[anchor], whole, start, windows, offset


def segments(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Of texts one after another: (text, anchor hash, segment hash, start, windows, offset) as arrays."""
    n = len(symbols) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    valid = np.zeros(n, bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        valid[a : max(a, b - length + 1)] = True
    parts = []
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        a, s, start, windows, offset = _slice(symbols[lo : hi + length - 1], valid[lo:hi], length, gram)
        parts.append((a, s, start + lo, windows, offset))
    a, s, start, windows, offset = (np.concatenate(p) for p in zip(*parts, strict=True))
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, a, s, start - bounds[text], windows, offset


def place(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start * 65536 + windows * 256 + offset


def unplace(loc):
    return loc // 65536, loc // 256 % 256, loc % 256


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, text and a key of the row: equal rows share it, others don't, whatever their ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    return docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.isnull("doc_id"), "text").alias("row"), "doc_id", "text", *carry)


def squeezed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row, doc_id, columns to carry and the text's bytes compressed, for joins that move whole texts. Null: empty."""
    carry = carry or []

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(t.tobytes()) for t in raw_texts(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "doc_id"), pa.array(packed, pa.binary()), *(column(batch, c) for c in carry)], names=["row", "doc_id", "packed", *carry])

    schema = docs.select("row", "doc_id").schema.add("packed", "binary")
    for c in carry:
        schema = schema.add(docs.schema[c])
    return docs.select("row", "doc_id", "text", *carry).mapInArrow(run, schema)


def unsqueezed(arr: pa.Array):
    press = zstandard.ZstdDecompressor()
    for b in arr:
        yield press.decompress(b.as_py())
