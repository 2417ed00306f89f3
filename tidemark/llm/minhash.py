"""Near duplicates by b-bit MinHash and a multi-index Hamming join.

A document is the set of its distinct word shingles. Equal sets collapse to one class by a map-side
aggregate, so that groups of copies cost one row. A class has a signature of 64 positions of 16
bits; the distance of two is the number of positions that differ. Signatures within E positions
are found without exception: E errors over E // 2 + 1 chunks leave a chunk with at most one (pigeonhole),
and a chunk with at most one error is found by enumerating which of its positions to leave out.
E follows from the similarity asked for (24 at 0.85, 28 at 0.80).

Within a key's bucket no pairs are emitted. Each class is first compared with the bucket's smallest
class (one row per class); linked classes merge. Only buckets that still hold several components
are then searched for pairs across components within the distance, in blocks. All links are
confirmed on full shingle sets. A true link lies beyond E positions with probability below MISS
at the similarity asked for, and far less above.

Inside, a row goes by a number of its own (uid), not by its doc_id, so that rows without doc_id and
rows that share one are linked by their own texts. Null texts and texts without words have the
empty set and no links. A component's id is the smallest doc_id in it, null if no row has one; `kept`
rows are those whose doc_id is the component's, and one row of each component is its `original`: of
smallest doc_id, nulls last. Repeated rows give repeated rows. Other columns of the input are ignored
unless carried, an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, block_words, by_group, column, components, forest, mix, range_hash, text_blocks
from .segments import squeezed, unsqueezed

POSITIONS, SHINGLE = 64, 5
#: The chance that a pair at the similarity asked for isn't found, at most.
MISS = 5e-6
#: Rows of a star, and classes of a bucket's block, that one task takes at a time.
STAR_BLOCK, PAIR_BLOCK = 256, 1024
#: Shingles of a family's block, and tokens that its links are counted over at a time.
BLOCK_SHINGLES, SMALLEST, TOKENS = 500_000, 1000, 2048
#: Bytes of text whose sets a task holds at a time.
TEXTS = 1 << 19

_A = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def errors_for(percent: int) -> int:
    """The least number of positions that a pair of this similarity exceeds with probability MISS at most."""
    p, beyond = 1 - percent / 100, 1.0
    for e in range(POSITIONS):
        beyond -= math.comb(POSITIONS, e) * p**e * (1 - p) ** (POSITIONS - e)
        if beyond <= MISS:
            return e
    return POSITIONS


def _bounds(errors: int) -> list[np.ndarray]:
    return np.array_split(np.arange(POSITIONS), errors // 2 + 1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    words, cut = block_words(_LOWER[data], bounds)
    n = len(words)
    grams = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:  # fewer words: the whole sequence is the one shingle
            out.append(range_hash(mix(words[a:b]), np.array([0]), np.array([b - a])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of POSITIONS 16-bit values per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), POSITIONS), np.uint64)
    for lo in range(0, len(sets), 256):
        hi = min(lo + 256, len(sets))
        a = starts[lo]
        part = flat[a : starts[hi] if hi < len(sets) else len(flat)]
        at = starts[lo:hi] - a
        for k in range(POSITIONS):
            out[lo:hi, k] = np.minimum.reduceat(part * _A[k], at)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def _with_sets(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        texts = column(batch, "text") if "text" in batch.schema.names else pa.array(list(unsqueezed(column(batch, "packed"))), pa.binary())
        for first, data, bounds in text_blocks(texts, TEXTS):
            yield batch.slice(first, len(bounds) - 1), shingle_sets(data, bounds, width)


def _describe(width: int, carry: list[str]):
    names = ["doc_id", "text", *carry, "n_shingles", "h1", "h2", "sig"]

    def run(batches):
        for rows, sets in _with_sets(batches, width):
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, h1, h2 = [None] * len(sets), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                found = signatures([sets[i] for i in full])
                for i, s in zip(full, found, strict=True):
                    sig[i] = s.tobytes()
                    h1[i], h2[i] = sets[i].sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(sets[i]))
            yield pa.RecordBatch.from_arrays(
                [*(column(rows, n) for n in names[:-4]), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sig, pa.binary())],
                names=names,
            )

    return run


def _keys(errors: int):
    """The bucket keys of each class: a chunk's place, the place left out, and the other values."""

    def run(batches):
        for batch in batches:
            ids = column(batch, "rep").to_numpy()
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
            salt = mix(np.arange(1, POSITIONS * 2 + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
            coded = mix((sig + np.uint64(1)) * salt[:POSITIONS])
            keys = []
            for c, places in enumerate(_bounds(errors)):
                whole = coded[:, places].sum(axis=1, dtype=np.uint64)
                for p in places:
                    keys.append(mix(whole - coded[:, p] + salt[POSITIONS + p] + np.uint64(c)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], names=["key", "rep"])

    return run


def _within_distance(errors: int):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(column(batch, n).to_pylist()), np.uint16).reshape(-1, POSITIONS) for n in ("sig_a", "sig_b"))
            near = np.count_nonzero(a != b, axis=1) <= errors
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _crossings(errors: int):
    """Per bucket: a forest of the pairs of different components within the distance, found in blocks."""

    def run(batches):
        for g in by_group(batches, ["key"]):
            ids, comp = g.column("rep").to_numpy(), g.column("component").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            order = np.argsort(comp, kind="stable")
            ids, comp, sig = ids[order], comp[order], sig[order]
            trees: set[tuple[int, int]] = set()
            for lo in range(0, len(ids), PAIR_BLOCK):
                own = slice(lo, lo + PAIR_BLOCK)
                # a row's partners come after the last row of its component
                first = np.searchsorted(comp, comp[own], side="right")
                for at in range(int(first.min()), len(ids), PAIR_BLOCK):
                    other = slice(at, at + PAIR_BLOCK)
                    apart = np.zeros((len(ids[own]), len(ids[other])), np.uint8)
                    for p in range(POSITIONS):
                        apart += sig[own, p, None] != sig[None, other, p]
                    i, j = np.nonzero((apart <= errors) & (np.arange(at, at + len(ids[other])) >= first[:, None]))
                    if len(i):
                        trees = forest(np.concatenate([ids[own][i], [a for a, _ in trees]]).astype(np.int64), np.concatenate([ids[other][j], [b for _, b in trees]]).astype(np.int64))
            yield _edges([a for a, _ in trees], [b for _, b in trees])

    return run


def _block_links(percent: int):
    """Of two blocks of a family's full sets: a forest of the links between them."""

    def run(batches):
        for g in by_group(batches, ["family", "x", "y"]):
            x, y, block = (g.column(n).to_numpy() for n in ("x", "y", "block"))
            ids, comp = g.column("rep").to_numpy(), g.column("component").to_numpy()
            sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in g.column("shingles")]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), size)
            _, token, n = np.unique(flat, return_inverse=True, return_counts=True)
            # what only one set holds can't be shared
            common = np.cumsum(n > 1) - 1
            some = n[token] > 1
            token, owner = common[token[some]], owner[some]
            left, right = np.flatnonzero(block == x[0]), np.flatnonzero(block == y[0])
            both = np.zeros((len(left), len(right)), np.int64)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for lo in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS):
                part = slice(*np.searchsorted(token, [lo, lo + TOKENS]))
                grid = np.zeros((len(sets), TOKENS), np.float32)
                grid[owner[part], token[part] - lo] = 1
                both += (grid[left] @ grid[right].T).astype(np.int64)  # counts up to TOKENS are exact
            union = size[left][:, None] + size[right][None, :] - both
            i, j = np.nonzero((both > 0) & (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
            trees = forest(ids[left][i], ids[right][j])
            yield _edges([a for a, _ in trees], [b for _, b in trees])

    return run


def _send_sets(width: int):
    """A class's full set to each star it belongs to."""

    def run(batches):
        for rows, sets in _with_sets(batches, width):
            hubs, parts, centre = (column(rows, n).to_pylist() for n in ("hubs", "parts", "centre"))
            out = [(h, p, c, s.tobytes()) for hs, ps, cs, s in zip(hubs, parts, centre, sets, strict=True) for h, p, c in zip(hs, ps, cs, strict=True)]
            ids = [d for d, hs in zip(column(rows, "rep").to_pylist(), hubs, strict=True) for _ in hs]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(ids, pa.int64()), pa.array(cols[3], pa.binary())], names=["hub", "part", "centre", "rep", "shingles"])

    return run


def _confirm(percent: int):
    """Of rows sorted by star, the hub's first: the links of the hub."""

    def run(batches):
        star, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, part, centre, rep, s in zip(*(column(batch, n).to_pylist() for n in ("hub", "part", "centre", "rep")), column(batch, "shingles"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if not centre:
                    star, own = (hub, part), s
                    continue
                assert star == (hub, part), "a star came without its hub"
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(s) - both):
                    a.append(hub)
                    b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _texts(base: DataFrame) -> DataFrame:
    """Compressed texts, to be joined by merging at any size."""
    rows = base.select(F.lit(0).cast("long").alias("row"), F.col("uid").alias("doc_id"), "text")
    return squeezed(rows).select(F.col("doc_id").alias("rep"), "packed").hint("merge")


def _links(base: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. A star of many rows is cut into parts."""
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / STAR_BLOCK).cast("int").alias("n_parts"))
    hubs = stars.select(F.col("a").alias("rep"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.lit(0).alias("centre"))
    leaves = pairs.join(stars, "a").select(F.col("b").alias("rep"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "n_parts").cast("int").alias("part"), F.lit(1).alias("centre"))
    wanted = hubs.unionByName(leaves).groupBy("rep").agg(F.collect_list("hub").alias("hubs"), F.collect_list("part").alias("parts"), F.collect_list("centre").alias("centre"))
    texts = _texts(base).join(wanted, "rep").select("rep", "packed", "hubs", "parts", "centre")
    sent = texts.mapInArrow(_send_sets(width), "hub long, part int, centre int, rep long, shingles binary")
    return sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "centre").mapInArrow(_confirm(percent), "a long, b long")


def _family_links(base: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """A forest of the links within each family. members: rep, family, component, weight.

    A family is cut into blocks of about BLOCK_SHINGLES shingles; each pair of blocks is a group.
    """
    # at least SMALLEST each, so that a block has BLOCK_SHINGLES / SMALLEST members or so at most
    total = members.groupBy("family").agg(F.ceil(F.sum(F.greatest("weight", F.lit(SMALLEST))) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = members.join(total, "family").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    texts = _texts(base).join(own, "rep").select("rep", "packed", "family", "component", "block", "blocks")

    def send(batches):
        for rows, sets in _with_sets(batches, width):
            out = [(f, min(b, k), max(b, k), b, r, c, s.tobytes()) for f, c, b, n, r, s in zip(*(column(rows, n).to_pylist() for n in ("family", "component", "block", "blocks", "rep")), sets, strict=True) for k in range(n)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["family", "x", "y", "block", "rep", "component", "shingles"])

    sent = texts.mapInArrow(send, "family long, x int, y int, block int, rep long, component long, shingles binary")
    return sent.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = SHINGLE, percent: int = 85, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, original, uid. With carry, only the
    originals: doc_id, text and the columns named."""
    errors = errors_for(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(carry or []))
    schema = docs.select("*").schema
    for n, kind in (("n_shingles", "long"), ("h1", "long"), ("h2", "long"), ("sig", "binary")):
        schema = schema.add(n, kind)
    base = docs.mapInArrow(_describe(width, carry or []), schema).withColumn("uid", F.monotonically_increasing_id())
    base = scratch.keep(base, "base")
    same = ["n_shingles", "h1", "h2"]
    one = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "uid")).alias("one")
    classes = base.where("n_shingles > 0").groupBy(*same).agg(F.first("sig").alias("sig"), one)
    classes = scratch.keep(classes.select(*same, "sig", "one.no_id", "one.doc_id", F.col("one.uid").alias("rep")), "classes")
    sigs = classes.select("rep", "sig")
    keys = sigs.mapInArrow(_keys(errors), "key long, rep long")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the join's sides are plain shuffles, whose hot partitions Spark splits
    hubs = scratch.keep(hubs.select("key", "hub"), "hubs")
    members = scratch.keep(keys.join(hubs, "key"), "members")
    scratch.release()

    def near(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
        return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_within_distance(errors), "a long, b long")

    stars = scratch.keep(near(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()), "stars")
    links = scratch.keep(_links(base, stars, width, percent), "links")
    found = scratch.keep(components(scratch, links, "first"), "found")
    scratch.release()

    # buckets that still hold several components: families of classes that pairs across them connect
    placed = members.select("key", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2")
    crowd = placed.join(open_.select("key"), "key").join(sigs, "rep").select("key", "rep", "component", "sig")
    crossing = crowd.repartition("key").sortWithinPartitions("key").mapInArrow(_crossings(errors), "a long, b long").distinct()
    crossing = scratch.keep(crossing, "crossing")
    scratch.drop("members", "stars", "hubs")
    scratch.release()
    if not crossing.isEmpty():
        families = scratch.keep(components(scratch, crossing, "families"), "family")
        own = families.select(F.col("node").alias("rep"), F.col("component").alias("family"))
        own = own.join(classes.select("rep", F.col("n_shingles").alias("weight")), "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        own = scratch.keep(own.withColumn("component", F.coalesce("component", "rep")), "own")
        more = scratch.keep(_family_links(base, own, width, percent), "more")
        found = scratch.keep(components(scratch, links.unionByName(more), "second"), "final")
        scratch.release()
    rooted = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rooted = scratch.keep(rooted.select(*same, "no_id", "doc_id", "rep", "component"), "rooted")
    best = rooted.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", *same, "rep")).alias("best"))
    if carry is not None:  # only rows that aren't the original of a component leave
        copies = base.where("n_shingles > 0").select("uid").join(best.select(F.col("best.rep").alias("uid")), "uid", "left_anti")
        return base.select("uid", "doc_id", "text", *carry).join(copies, "uid", "left_anti").drop("uid")
    rooted = rooted.select(*same, "component").join(best.select("component", F.col("best.doc_id").alias("component_id"), F.col("best.rep").alias("first")), "component")
    out = base.select("uid", "doc_id", *same).join(rooted.select(*same, "component_id", "first"), same, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("uid") == F.col("first"), F.lit(True)).alias("original"), "uid")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "original", "uid")
