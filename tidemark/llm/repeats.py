"""Removal of repeated byte strings (suffix-array dedup).

Every window of LENGTH bytes belongs to one anchored segment (segments.py), whose bytes have a BLAKE2
digest. Anchors that occur once hold no repeat. Where all segments of an anchor are equal, all their
windows repeat; so do those of a segment that occurs twice; equal ones of a task are found there. What is left, segments that share an anchor and differ, is settled on
the symbols: one copy of each goes, by anchor, into a text whose suffixes are sorted; breadth-first
backward extension on its Burrows-Wheeler transform yields the boundaries between suffixes in order
of rising common prefix, and stops at LENGTH. Rows that no boundary separates share LENGTH bytes.

An anchor with more than CROWD different segments is split before that: its windows are halved by
their offset from the anchor and dealt anew by the bytes that all windows of the half share, until
groups are small or windows single, so a passage that most documents hold never meets in one task.

Null texts are empty. Texts shorter than LENGTH lose nothing. Equal rows remove each other's
strings as any other documents do. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _BYTE, Scratch, column, mix, range_hash, text_blocks
from .segments import keyed, place, segments, squeezed, unplace, unsqueezed

LENGTH, GRAM = 200, 32
#: Different segments of a group that one task takes, and bytes that it sorts together.
CROWD, TEXT = 2048, 1 << 19
#: Bytes of text whose segments a task looks for at a time, and segments that it combines.
BLOCK, COMBINE = 1 << 19, 1 << 17
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols 0..256 sorted by their first `depth` symbols or more, by prefix doubling."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for j in range(6):
        key = key * 512
        key[: n - j] += text[j:] + 1
    order = np.argsort(key)
    done = 6
    while True:
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if done >= depth:
            return order
        key = rank * (n + 1)
        key[: n - done] += rank[done:] + 1
        order = np.argsort(key)
        done *= 2


def separated(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text (0 separates its parts), and for each row whether its common prefix
    with the row before is shorter than `depth`; prefixes that hold a separator aren't resolved.

    Breadth-first over intervals of rows: round l extends each interval of a string of l - 1 symbols
    to the left by each symbol in it. A child's end that has no boundary yet gets one, of common
    prefix l, and the child goes into the next round.
    """
    n = len(text)
    order = suffix_order(text, depth)
    bwt = text[order - 1]  # the text's first symbol follows its last, a separator
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    same = bwt[psi][1:] == bwt[psi][:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[psi[:-1][same]] = psi[1:][same]
    before[psi[1:][same]] = psi[:-1][same]
    cut = np.zeros(n + 1, bool)
    first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=257))])
    first = np.unique(first)
    cut[first] = True
    low, high = first[:-1], first[1:]
    for _ in range(1, depth):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        letter = bwt[rows] > 0
        ends = np.sort(lf[rows[letter & (after[rows] >= high[owner])]]) + 1
        starts = np.sort(lf[rows[letter & (before[rows] < low[owner])]])
        new = ~cut[ends]
        low, high = starts[new], ends[new]
        cut[high] = True
    return order, cut[:n]


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, whether the string of `length` bytes at each of its starts occurs at another start of any part."""
    sizes = np.array([len(p) for p in parts])
    text = np.zeros(int(sizes.sum()) + len(parts), np.int16)
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    body = np.ones(len(text), bool)
    body[at + sizes] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    order, cut = separated(text, length)
    group = np.cumsum(cut)
    many = np.bincount(group)[group] > 1
    hit = np.zeros(len(text), bool)
    hit[order] = many
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(at, sizes, strict=True)]


def _occurrences(length: int, gram: int):
    """The segments of each text. Of equal ones within a task, which all repeat (`twin`), only one is `single`
    and goes on to be compared with those of other tasks."""

    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, s, row, loc = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((loc, row, s, a))
        a, s, row, loc = (x[order] for x in (a, s, row, loc))
        single = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
        kind = np.cumsum(single) - 1
        twin = np.bincount(kind)[kind] > 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, s, row, loc, twin, single)], names=["a", "s", "row", "loc", "twin", "single"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            row = column(batch, "row").to_numpy()
            for first, data, bounds in text_blocks(column(batch, "text"), BLOCK):
                text, a, _, start, windows, offset = segments(_BYTE[data], bounds, length, gram)
                raw, begin = data.tobytes(), bounds[text] + start
                s = b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip(begin.tolist(), (begin + windows + length - 1).tolist(), strict=True)])
                held.append((a.view(np.int64), np.frombuffer(s, np.int64), row[first + text], place(start, windows, offset)))
                size += len(a)
                if size > COMBINE:
                    yield combined(held)
                    held, size = [], 0
        if size:
            yield combined(held)

    return run


def _cut_out(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, row, wanted in zip(unsqueezed(column(batch, "packed")), column(batch, "row").to_pylist(), column(batch, "wanted").to_pylist(), strict=True):
                for w in wanted:
                    start, windows, _ = unplace(w["loc"])
                    for o, v in zip(out, (w["a"], row, w["loc"], w["known"], text[start : start + windows + length - 1]), strict=True):
                        o.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["g", "row", "loc", "known", "bytes"])

    return run


PART = "g long, h long, row long, loc long, known boolean, lo int, hi int, bytes binary"


def _halve(length: int):
    """Each part's windows in two by offset from the anchor; the group is that of the bytes all of a half share."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for g, row, loc, known, lo, hi, data in zip(*(column(batch, n).to_pylist() for n in ("g", "row", "loc", "known", "lo", "hi", "bytes")), strict=True):
                start, windows, offset = unplace(loc)
                mid = (lo + hi + 1) // 2
                symbols = _BYTE[np.frombuffer(data, np.uint8)]
                for a, b in ((lo, mid - 1), (mid, hi)):
                    i, j = max(0, offset - b), min(windows - 1, offset - a)  # starts whose offset is in a..b
                    if i > j:
                        continue
                    core = range_hash(symbols, np.array([offset - a]), np.array([offset - b + length]))
                    new = mix(core + np.uint64(a * 256 + b) + np.array([g]).view(np.uint64) * np.uint64(3))
                    own = data[i : j + length]
                    h = range_hash(symbols, np.array([i]), np.array([j + length])) + np.uint64(offset - i)
                    for o, v in zip(out, (int(new.view(np.int64)[0]), int(h.view(np.int64)[0]), row, (start + i) * 65536 + (j - i + 1) * 256 + offset - i, known, a, b, own), strict=True):
                        o.append(v)
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PART.split(", ")])

    return run


def _settle(length: int):
    """Of rows sorted by group: the repeated windows of parts not known to repeat, as places."""

    def solve(rows: list[tuple]) -> tuple[list, list]:
        where, places = [], []
        for (_, row, loc, known, _), hit in zip(rows, repeated([r[4] for r in rows], length), strict=True):
            if known or not hit.any():
                continue
            start = unplace(loc)[0]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                where.append(row)
                places.append(int((start + a) * 65536 + (b - a) * 256))
        return where, places

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush(rows):
            where, places = solve(rows)
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(places, pa.int64())], names=["row", "loc"])

        for batch in batches:
            for r in zip(*(column(batch, n).to_pylist() for n in ("g", "row", "loc", "known", "bytes")), strict=True):
                if size > TEXT and r[0] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
                last = r[0]
        if held:
            yield flush(held)

    return run


def _remove(length: int, carry: list[str]):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, places in zip(column(batch, "doc_id").to_pylist(), unsqueezed(column(batch, "packed")), column(batch, "places").to_pylist(), strict=True):
                n, removed, spans, kept = len(text), 0, 0, text
                if places:
                    start, windows, _ = unplace(np.array(places))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + windows + length - 1, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    removed = int(gone.sum())
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + [column(batch, c) for c in carry], names=[x.split()[0] for x in OUT.split(", ")] + carry)

    return run


def _split_crowds(parts: DataFrame, scratch: Scratch, length: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """Parts in groups of at most `crowd`, and the places found on the way."""
    found, k = [], 0
    while True:
        sizes = parts.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("top"), F.min("lo").alias("low"))
        crowds = scratch.keep(sizes.where(f"n > {crowd} and top > low").select("g"), f"crowds-{k}")
        if crowds.isEmpty():
            return parts, found
        k += 1
        halves = parts.join(crowds, "g", "left_semi").drop("h").mapInArrow(_halve(length), PART)
        halves = scratch.keep(halves, f"halves-{k}")
        # equal parts of a group repeat each other; one of them stays to be found by others
        kinds = halves.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "loc")).alias("one"))
        halves = halves.join(kinds, ["g", "h"])
        found.append(halves.where("n > 1 and not known").select("row", "loc"))
        rest = halves.where("row = one.row and loc = one.loc").withColumn("known", F.expr("known or n > 1")).drop("n", "one")
        # several equal rows may share row and loc
        rest = rest.dropDuplicates(["g", "h"]).select(*[x.split()[0] for x in PART.split(", ")])
        parts = scratch.keep(parts.join(crowds, "g", "left_anti").unionByName(rest), f"parts-{k}")


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), and columns to carry."""
    carry = carry or []
    docs = keyed(docs, carry)
    occ = scratch.keep(docs.select("row", "text").mapInArrow(_occurrences(length, gram), "a long, s long, row long, loc long, twin boolean, single boolean"), "occurrences")
    singles = occ.where("single").drop("single")
    anchors = singles.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("n > 1")
    # written, so that the join's sides are plain shuffles, whose hot partitions Spark splits
    anchors = scratch.keep(anchors.select("a", (F.col("lo") == F.col("hi")).alias("uniform")), "anchors")
    scratch.release()
    shared = scratch.keep(singles.join(anchors, "a"), "shared")
    scratch.drop("anchors")
    scratch.release()
    mixed = shared.where("not uniform")
    kinds = scratch.keep(mixed.groupBy("a", "s").agg((F.count(F.lit(1)) + F.max(F.col("twin").cast("int"))).alias("n"), F.min(F.struct("row", "loc")).alias("one")), "kinds")
    known = mixed.where("not twin").join(kinds.where("n > 1").select("a", "s"), ["a", "s"]).select("row", "loc")
    wanted = kinds.select(F.col("one.row").alias("row"), F.struct("a", F.col("one.loc").alias("loc"), F.expr("n > 1").alias("known")).alias("w"))
    wanted = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    parts = squeezed(docs).join(wanted, "row")
    parts = parts.select("row", "packed", "wanted").mapInArrow(_cut_out(length), "g long, row long, loc long, known boolean, bytes binary")
    parts = parts.withColumns({"h": F.lit(0).cast("long"), "lo": F.lit(0), "hi": F.lit(length - gram)}).dropDuplicates(["g", "row", "loc"])
    parts = scratch.keep(parts.select(*[x.split()[0] for x in PART.split(", ")]), "parts-0")
    parts, found = _split_crowds(parts, scratch, length, crowd)
    settled = parts.select("g", "row", "loc", "known", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(_settle(length), "row long, loc long")
    places = occ.where("twin").select("row", "loc").unionByName(shared.where("uniform").select("row", "loc")).unionByName(known).unionByName(settled)
    for f in found:
        places = places.unionByName(f)
    places = places.groupBy("row").agg(F.collect_set("loc").alias("places"))
    out = squeezed(docs, carry).join(places, "row", "left").select("doc_id", "packed", "places", *carry)
    schema = StructType.fromDDL(OUT)
    for c in carry:
        schema = schema.add(docs.schema[c])
    return out.mapInArrow(_remove(length, carry), schema)
