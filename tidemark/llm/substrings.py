"""Incremental removal of word sequences that occurred before (substring dedup).

The index of what was seen is log-structured: immutable sorted runs, one of a kind per batch, and
two runs of a level are compacted into one of the next. Runs are bucketed by their key, so a batch
is dealt out once and merge-joined with every run, which itself is never shuffled again.

Windows of `window` words are grouped into segments of one anchor (segments.py). The anchor runs
hold one row per anchor: the digest and place of the first segment seen, and whether others that
differ have come since (`mixed`). A segment of an anchor that isn't mixed is as a whole new or seen
before. Of segments of mixed anchors, each window is looked up in the window runs, which hold the
digest of each such window and the document where it came first. When an anchor becomes mixed, the
windows of its first segment follow from the texts that the index keeps.

Hashes of words only pick candidates. Equality is verified on the words: segments and windows count
as equal if BLAKE2 digests (128 bits) of their words, joined by one space, agree.

Batches are ranges of doc_id in ascending order, so what a batch meets in the runs comes earlier.
A window is removed if it also starts in a document of smaller doc_id, or earlier in its own row.
Rows without doc_id come last. Rows with the same doc_id (or none) don't remove each other's words,
whether their texts are equal or not; each is judged by its own text.

Equal segments and windows within a task are combined before any shuffle, so a passage in a third
of all rows costs a row per task; different segments that share an anchor meet in a join that
Spark can split. Null texts have no words. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, Scratch, column, range_hash, raw_texts, words_of
from .segments import place, segments, unplace, unsqueezed

WINDOW, GRAM, BATCHES = 20, 5, 3
#: Segments or windows of a task that are combined at a time, and bytes of text taken together.
COMBINE, BLOCK = 1 << 17, 1 << 19
LAST = (1 << 63) - 1
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
TEXTS = "row long, doc long, doc_id long, packed binary"
#: Segments of a batch, and windows of mixed anchors; `gone` marks those that follow an equal one of their task.
SEEN = "a long, s long, t long, doc long, row long, loc long, gone boolean"
MET = "w long, v long, doc long, row long, start long, gone boolean"


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text joined by one space, compressed."""
    for batch in batches:
        press = zstandard.ZstdCompressor(level=1)
        packed = [press.compress(b" ".join(t.tobytes().split())) for t in raw_texts(column(batch, "text"))]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("row", "doc", "doc_id")), pa.array(packed, pa.binary())], names=["row", "doc", "doc_id", "packed"])


def blocks_of(arr: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, texts one after another, starts and ends of their words, bounds of the texts among these)."""
    held, size, first = [], 0, 0

    def block():
        text = b"\n".join(held)
        start, end = words_of(np.frombuffer(text, np.uint8))
        return first, text, start, end, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in held)]))

    for i, t in enumerate(unsqueezed(arr)):
        if held and size + len(t) > BLOCK:
            yield block()
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield block()


def digests(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each text[start:end], as two longs."""
    h = hashlib.blake2b
    flat = b"".join([h(text[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(flat, np.int64).reshape(-1, 2)


def combined(parts: list[tuple[np.ndarray, ...]], kind: int, names: list[str]) -> pa.RecordBatch:
    """Rows (kind columns, doc, row, place), each once. `gone`: an equal kind has a smaller doc, or comes earlier in the row."""
    cols = [np.concatenate(p) for p in zip(*parts, strict=True)]
    cols = [c[order] for order in [np.lexsort(cols[::-1])] for c in cols]

    def begins(upto: int) -> np.ndarray:
        new = np.zeros(len(cols[0]), bool)
        new[:1] = True
        for c in cols[:upto]:
            new[1:] |= c[1:] != c[:-1]
        return new

    def first_of(new: np.ndarray, c: np.ndarray) -> np.ndarray:
        return c[new][np.cumsum(new) - 1]

    doc, at = cols[kind], cols[kind + 2]
    gone = (doc > first_of(begins(kind), doc)) | (at > first_of(begins(kind + 2), at))
    once = begins(kind + 3)
    return pa.RecordBatch.from_arrays([pa.array(c[once]) for c in (*cols, gone)], names=names)


def _fingerprints(window: int, gram: int):
    """The segments of each text."""
    names = [x.split()[0] for x in SEEN.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs, rows = column(batch, "doc").to_numpy(), column(batch, "row").to_numpy()
            for first, text, begin, end, cut in blocks_of(column(batch, "packed")):
                words = range_hash(_BYTE[np.frombuffer(text, np.uint8)], begin, end) if len(begin) else np.empty(0, np.uint64)
                own, a, _, start, windows, offset = segments(words, cut, window, gram)
                if not len(a):
                    continue
                at = cut[own] + start
                d = digests(text, begin[at], end[at + windows + window - 2])
                held.append((a.view(np.int64), d[:, 0], d[:, 1], docs[first + own], rows[first + own], place(start, windows, offset)))
                size += len(a)
                if size > COMBINE:
                    yield combined(held, 3, names)
                    held, size = [], 0
        if size:
            yield combined(held, 3, names)

    return run


def _windows(window: int):
    """The windows of the wanted segments of each text."""
    names = [x.split()[0] for x in MET.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            wanted = column(batch, "wanted")
            docs, rows = column(batch, "doc").to_numpy(), column(batch, "row").to_numpy()
            for i, text in enumerate(unsqueezed(column(batch, "packed"))):
                begin, end = words_of(np.frombuffer(text, np.uint8))
                start, n, _ = unplace(np.unique(np.array(wanted[i].as_py(), np.int64)))
                at = np.unique(np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                d = digests(text, begin[at], end[at + window - 1])
                held.append((d[:, 0], d[:, 1], np.full(len(at), docs[i]), np.full(len(at), rows[i]), at))
                size += len(at)
                if size > COMBINE:
                    yield combined(held, 2, names)
                    held, size = [], 0
        if size:
            yield combined(held, 2, names)

    return run


def _remove(window: int):
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            rows, all_places = [], column(batch, "places")
            for i, (doc, text) in enumerate(zip(column(batch, "doc_id").to_pylist(), unsqueezed(column(batch, "packed")), strict=True)):
                words, places = text.split(), all_places[i].as_py()
                n, removed = len(words), 0
                if places:
                    start, windows, _ = unplace(np.array(places))
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + windows + window - 1, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((doc, n, removed, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


class FingerprintIndex:
    """What was seen, as runs in a folder that all executors share. It can be opened again by its path.

    anchors  a -> s, t (digest of the first segment), doc, row, loc (its place), mixed; newer runs override
    windows  w, v (digest) -> doc (the smallest)
    texts    row, doc, doc_id, packed; one table per batch
    """

    KEYS = {"anchors": ["a"], "windows": ["w", "v"]}

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.path, self.window, self.gram = spark, path, window, gram
        #: As many as tasks of a shuffle, so that a batch is dealt out as the runs are.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.steps, self.texts = 0, []
        self.runs: dict[str, list[tuple[int, str]]] = {k: [] for k in self.KEYS}  # (level, name), oldest first
        self.session = uuid.uuid4().hex
        self.known: set[str] = set()

    def save(self) -> None:
        state = {k: getattr(self, k) for k in ("window", "gram", "buckets", "steps", "texts", "runs")}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state-{self.steps}")
        self._delete(f"state-{self.steps - 1}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index of the last batch that was taken in as a whole."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        last = max(int(n.split("-")[1]) for n in names if n.startswith("state-"))
        state = json.loads(spark.read.text(f"{path}/state-{last}").first()[0])
        index = cls(spark, path, state["window"], state["gram"], state["buckets"])
        index.steps, index.texts = state["steps"], state["texts"]
        index.runs = {k: [tuple(r) for r in v] for k, v in state["runs"].items()}
        return index

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for name in self.known:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        self.known.clear()

    def _table(self, name: str) -> str:
        return f"tidemark_{self.session}_{name.replace('-', '_')}"

    def _delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if name in self.known:
            self.spark.sql(f"DROP TABLE {self._table(name)}")
            self.known.discard(name)

    def _plain(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _sorted(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Written in buckets, sorted by the keys."""
        df.write.mode("overwrite").format("parquet").option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(self._table(name))
        self.known.add(name)
        return self.spark.table(self._table(name))

    def run(self, name: str, keys: list[str], schema: str) -> DataFrame:
        if name not in self.known:  # of an index that was opened again
            by = ", ".join(keys)
            self.spark.sql(f"CREATE TABLE {self._table(name)} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.known.add(name)
        return self.spark.table(self._table(name))

    def anchors(self, name: str) -> DataFrame:
        return self.run(name, ["a"], "a BIGINT, s BIGINT, t BIGINT, doc BIGINT, row BIGINT, loc BIGINT, mixed BOOLEAN")

    def windows(self, name: str) -> DataFrame:
        return self.run(name, ["w", "v"], "w BIGINT, v BIGINT, doc BIGINT")

    def compact(self) -> None:
        """Two runs of a level become one of the next, by a merge of their buckets; the newer one prevails."""
        for kind, keys in self.KEYS.items():
            runs, read = self.runs[kind], getattr(self, kind)
            while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
                (level, new), (_, old) = runs.pop(), runs.pop()
                x, y = read(new).alias("x"), read(old).alias("y")
                both = x.join(y, keys, "full")
                name = f"{kind}-{self.steps}-{level + 1}"
                values = [c for c in read(new).columns if c not in keys]
                self._sorted(both.select(*keys, *(F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in values)), name, keys)
                runs.append((level + 1, name))
                self._delete(new)
                self._delete(old)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch (row, doc, doc_id, text), whose docs come after all before; gives the places
        (row, loc) of its windows that came before."""
        k, self.steps = self.steps, self.steps + 1
        plain = self._plain
        own = plain(batch.select("row", "doc", "doc_id", "text").mapInArrow(_normal, TEXTS), f"texts-{k}")
        self.texts.append(f"texts-{k}")
        seen = plain(own.select("row", "doc", "packed").mapInArrow(_fingerprints(self.window, self.gram), SEEN), f"seen-{k}")
        live = seen.where("not gone").drop("gone")

        # one row per anchor of the batch, with what the runs know of it
        now = live.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("s").alias("s_hi"), F.min("t").alias("t"), F.max("t").alias("t_hi"), F.min(F.struct("doc", "row", "loc")).alias("one"))
        old = [f"o{i}" for i in range(len(self.runs["anchors"]))][::-1]  # newest first
        for alias, (_, name) in zip(old, reversed(self.runs["anchors"]), strict=True):
            run = self.anchors(name)
            now = now.join(run.select("a", F.struct(*(c for c in run.columns if c != "a")).alias(alias)), "a", "left")
        before = F.coalesce(*old) if old else F.lit(None).cast("struct<s:bigint,t:bigint,doc:bigint,row:bigint,loc:bigint,mixed:boolean>")
        now = now.withColumn("b", before)
        differ = F.expr("s <> s_hi or t <> t_hi or coalesce(b.mixed or b.s <> s or b.t <> t, false)")
        fields = [F.expr(f"coalesce(b.{c}, {v})").alias(c) for c, v in (("s", "s"), ("t", "t"), ("doc", "one.doc"), ("row", "one.row"), ("loc", "one.loc"))]
        state = self._sorted(now.select("a", *fields, differ.alias("mixed"), F.expr("b is not null").alias("old"), F.expr("coalesce(b.mixed, false)").alias("was_mixed"), "n"), f"state-of-{k}", ["a"])

        # places of segments whose anchors are shared; written, so that the join's sides are plain shuffles, which Spark can split
        common = plain(state.where("n > 1 or old").select("a", "mixed", F.col("doc").alias("first")), f"common-{k}")
        shared = plain(live.join(common, "a").where("mixed or doc > first").select("row", "loc", "mixed"), f"shared-{k}")
        wanted = shared.where("mixed").select("row", "loc")
        texts = own
        if k:
            wanted = wanted.unionByName(state.where("old and mixed and not was_mixed").select("row", "loc"))
            texts = self.spark.read.schema(own.schema).parquet(*(f"{self.path}/{t}" for t in self.texts))
        wanted = wanted.groupBy("row").agg(F.collect_list("loc").alias("wanted"))
        met = texts.select("row", "doc", "packed").join(wanted.hint("merge"), "row").mapInArrow(_windows(self.window), MET)
        met = plain(met, f"met-{k}")

        # the smallest document of each window, and what the runs know of it
        keys = self.KEYS["windows"]
        first = met.where("not gone").drop("gone").repartition(self.buckets, *keys).withColumn("d", F.min("doc").over(Window.partitionBy(*keys)))
        old = []
        for _, name in self.runs["windows"]:
            old.append(f"o{len(old)}")
            first = first.join(self.windows(name).withColumnRenamed("doc", old[-1]), keys, "left")
        first = first.withColumn("h", F.coalesce(*old) if old else F.lit(None).cast("long")).select(*keys, "doc", "row", "start", "d", "h")
        first = self._sorted(first, f"first-{k}", keys)
        single = F.col("start") * 65536 + 256
        places = seen.where("gone").select("row", "loc").unionByName(shared.where("not mixed").select("row", "loc"))
        places = places.unionByName(met.where("gone").select("row", single.alias("loc"))).unionByName(first.where("doc > least(d, coalesce(h, d))").select("row", single.alias("loc")))
        places = plain(places, f"places-{k}")

        self._sorted(state.where("not old or mixed and not was_mixed").select("a", "s", "t", "doc", "row", "loc", "mixed"), f"anchors-{k}-0", ["a"])
        self._sorted(first.where("h is null").groupBy(*keys).agg(F.min("d").alias("doc")), f"windows-{k}-0", keys)
        for kind in self.KEYS:
            self.runs[kind].append((0, f"{kind}-{k}-0"))
        for name in ("seen", "state-of", "common", "shared", "met", "first"):
            self._delete(f"{name}-{k}")
        self.compact()
        self.save()
        return places


def remove_seen(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (words left, joined by a space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    # equal rows share a key, others don't, whatever their ids
    docs = docs.withColumn("row", F.xxhash64("doc", F.isnull("doc_id"), "text"))
    cuts = docs.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted({min(int(c), LAST) for c in cuts})
    index, every = FingerprintIndex(docs.sparkSession, f"{scratch.base}/index", window, gram), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs if hi is None else docs.where(F.col("doc") < hi)
        places = index.add(batch if lo is None else batch.where(F.col("doc") >= lo))
        every = places if every is None else every.unionByName(places)
        scratch.release()
    every = every.groupBy("row").agg(F.collect_list("loc").alias("places"))
    texts = docs.sparkSession.read.schema(TEXTS).parquet(*(f"{index.path}/{t}" for t in index.texts))
    out = texts.join(every.hint("merge"), "row", "left").select("doc_id", "packed", "places")
    index.close()
    return out.mapInArrow(_remove(window), OUT)
