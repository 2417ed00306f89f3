"""Shared helpers: table access, the shared scratch folder, hashing, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker takes at a time, unless the session says otherwise; texts can be long.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


class Scratch:
    """Tables written to the folder that all executors share (spark.checkpoint.dir).

    Writing cuts lineage: a lost executor costs only the tasks of the stage at hand.
    Only where the setting is absent and Spark is local (tests) is a temporary folder used.
    The session's Arrow batches become smaller (BATCH_ROWS) where it has no setting of its own.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidemark-")
        if spark.conf.get(BATCH_ROWS[0], None) in (None, "10000"):  # unset, or the default
            spark.conf.set(*BATCH_ROWS)
        self.spark, self.base = spark, f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{label}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Has Spark drop shuffle files of finished jobs now; it does so when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *labels: str) -> None:
        """Frees tables that no later plan reads."""
        for label in labels:
            self._delete(f"{self.base}/{label}")

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; new array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_POW, default=0)
    if size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        inv = pow(base, -1, 1 << 64)
        _POW.clear()
        _POW[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inv))
    return _POW[size]


def range_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end], equal for equal runs wherever they lie; symbols are uint64."""
    power, inverse = _powers(len(symbols) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(symbols * power[: len(symbols)], dtype=np.uint64)])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * _C2)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    solid = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = words_of(data)
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    return start, end, range_hash(_BYTE[data], start, end)


def block_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts one after another, and the texts' bounds among them."""
    # a line feed between texts keeps their words apart
    apart = np.full(len(data) + len(bounds) - 1, 10, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = data
    start, _, words = word_hashes(apart)
    return words, np.searchsorted(start, bounds + np.arange(len(bounds)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(arr: pa.Array):
    """The UTF-8 bytes of each row as uint8 arrays, without copies; null counts as empty."""
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(arr)):
        yield flat[off[i] : off[i + 1]] if valid[i] else flat[:0]


def text_blocks(arr: pa.Array, limit: int = 1 << 20):
    """(first row, bytes of several rows one after another, their bounds) in blocks of about limit bytes."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(raw_texts(arr)):
        if rows and size + len(t) > limit:
            yield first, np.concatenate(rows), np.cumsum([0, *map(len, rows)])
            rows, size, first = [], 0, i
        rows.append(t)
        size += len(t)
    if rows:
        yield first, np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by the named columns, a table for each group."""
    held, last = [], None
    for batch in batches:
        k = np.stack([column(batch, n).to_numpy() for n in names])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                now = tuple(k[:, a])
                if last is not None and now != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> set[tuple[int, int]]:
    """Edges to the smallest member of each component of the links."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    return {(int(ids[i]), int(ids[r])) for i, r in enumerate(low) if i != r}


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """(node, component): component is the smallest node that links reach, for every node of an edge.

    edges: a, b as longs. Alternating large-star and small-star steps; each round is written to
    the shared folder. Minima are pre-aggregated, and the join back is one that AQE can split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.keep(e, f"{label}-0")
    state = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    seen, k = tuple(e.agg(*state).first()), 0
    while True:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        e = scratch.keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-{k}")
        now = tuple(e.agg(*state).first())
        if now == seen:
            break
        seen = now
        scratch.drop(f"{label}-{k - 1}")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
