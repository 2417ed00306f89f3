"""Packing token sequences into windows by best-fit decreasing.

A document's ids are cut into full windows from its start; the rest (shorter than a window) is
packed. Best-fit decreasing depends on lengths alone, so it runs on the histogram of rest lengths,
which has at most window - 1 entries at any corpus size: a segment tree over remaining capacities
holds how many open windows have each capacity and finds the tightest one that still fits. The
plan is a short list of ranges (length, rank of the piece among its length) -> (window, offset);
ranks come from counts by task and length, summed in Spark. Nothing else reaches the driver.

Null texts are empty: a document of the end id alone. Rows with a null doc_id are packed like others.
Repeated rows are packed as often as they occur. An empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column

WINDOW, END_ID = 1024, 0
#: Words whose ids a task keeps at hand; beyond, the store starts anew. Results don't depend on it.
WORD_STORE = 1_000_000
#: The vocabulary's splitting rule (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"


class CapacityTree:
    """Counts of open windows by remaining capacity 0..size-1, as a segment tree."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def at(self, capacity: int) -> int:
        return self.count[capacity + self.leaves]

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least that an open window has, or -1."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first window, offset): ranks in a row go to windows in a row."""
    plan, tree, opened = [], CapacityTree(window + 1), 0
    ranges: dict[int, list[tuple[int, int]]] = {}  # capacity -> (first window, count)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, first, count = window, opened, left
            else:
                first, count = ranges[capacity].pop()
                tree.add(capacity, -count)
            # once it has a piece, a window is the tightest until no other of this length fits
            each = min(capacity // length, left)
            n = min(count, left // each)
            plan += [(length, rank + k * n, n, first, window - capacity + k * length) for k in range(each)]
            rank, left, opened = rank + each * n, left - each * n, max(opened, first + n)
            rest = [(capacity - each * length, first, n)]
            if capacity < window:
                rest.append((capacity, first + n, count - n))
            for free, start, k in rest:
                if k:
                    ranges.setdefault(free, []).append((start, k))
                    tree.add(free, k)
    return plan


class ChunkIds(dict):
    """Ids by chunk, found on first use. A chunk that the vocabulary may not cut off alone has None."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes | None:
        odd = not chunk or chunk[0].isspace() or chunk[-1].isspace()
        ids = None if odd else np.array(self.encode(self.lead + chunk), "<u4").tobytes()
        self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts under the byte-level vocabulary file at path (merges in order of id).

    A text is cut at single spaces between visible characters, where the vocabulary's own
    splitting always cuts as well, so that the ids of a chunk can be kept. Other texts go whole.
    Texts that hold one of the vocabulary's added tokens are left to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        # the file writes byte b as the b-th character of this alphabet
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, self.special, self.whole = path, [t["content"] for t in model.get("added_tokens", ())], None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.encode = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.renew()

    def renew(self) -> None:
        self.first, self.later = ChunkIds(self.encode, ""), ChunkIds(self.encode, " ")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(t in text for t in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.split(" ")
        if len(self.first) + len(self.later) > WORD_STORE:
            self.renew()
        try:
            return b"".join([self.first[chunks[0]], *map(self.later.__getitem__, chunks[1:])])
        except TypeError:  # an odd chunk
            return np.array(self.encode(text), "<u4").tobytes()


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, task = Encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(window + 1, np.int64)
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
    for batch in batches:
        out = [[] for _ in names]
        for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
            tokens = encode(text.as_py() or "") + end
            total = len(tokens) // 4
            for start in range(0, total, window):
                length = min(window, total - start)
                crc = zlib.crc32(memoryview(tokens)[4 * start : 4 * (start + length)])
                for o, v in zip(out, (doc, start, length, crc, total, task, int(seen[length])), strict=True):
                    o.append(v)
                seen[length] += 1
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, scratch: Scratch, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, tokenizer, window, end_id), PIECES)
    pieces = scratch.keep(pieces, "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = scratch.keep(by_task, "by_task")
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(histogram, window)
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length long, first_rank long, n long, first_sequence long, offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    # at most window^2 / 2 ranges whatever the corpus, in practice a few thousand
    placed = ranked.alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    return placed.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
