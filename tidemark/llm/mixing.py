"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell's weight is its number of tokens
(words). Raking scales the cells to each marginal's target shares in turn until all agree. A cell's
raked over observed weight, times one factor, is the probability with which its documents are
kept; the factor is such that the expected tokens are `budget` of all, and no probability exceeds
one. Whether a document is kept depends on a hash of its id alone.

Every category has a target of its own. Up to CELLS cells are raked on the driver; more stay in Spark,
where a table of factors for each dimension is improved by aggregates and joins. Targets not given are
the observed shares to the power TEMPER, which lifts small categories. A target of an absent category
is left out and the others are scaled up.

A document's topic is its `topic` column if there is one, else a lexical one: the bucket of its
most frequent word of at least six bytes (lower-cased; the least of equals), or none. Nulls are a
category of their own. A null doc_id is replaced by the text's hash. Repeated rows share one fate.
An empty table gives no rows. Columns of docs are kept, but for those that the result replaces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, raw_texts

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
TOPICS, LEAST_BYTES, BUDGET, SEED = 8, 6, 0.7, 20
NULL, NO_TOPIC = "~null", "none"
#: Cells that the driver takes.
CELLS = 300_000


def lexical_topic(words: list[bytes]) -> str:
    long = Counter(w for w in words if len(w) >= LEAST_BYTES)
    if not long:
        return NO_TOPIC
    most = max(long.values())
    return f"t{zlib.crc32(min(w for w, n in long.items() if n == most)) % TOPICS}"


def described(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of docs with mix_tokens and mix_topic."""
    own = "topic" in docs.columns
    columns = [c for c in columns if c not in ("mix_tokens", "mix_topic")]
    columns += ["topic"] if own and "topic" not in columns else []
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = docs.select(*columns).schema.add("mix_tokens", "long").add("mix_topic", "string")

    def run(batches):
        for batch in batches:
            tokens, topics = [], []
            for text in raw_texts(column(batch, "text")):
                words = text.tobytes().lower().split()
                tokens.append(len(words))
                topics.append(None if own else lexical_topic(words))
            out = [*(column(batch, c) for c in columns), pa.array(tokens, pa.int64()), pa.array(topics, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "mix_tokens", "mix_topic"])

    out = docs.mapInArrow(run, schema)
    return out.withColumn("mix_topic", F.col("topic").cast("string")) if own else out


def rake(weights: np.ndarray, cells: list[np.ndarray], targets: list[np.ndarray], close: float = 1e-10) -> np.ndarray:
    """Weights scaled so that the shares of each dimension's categories are its targets. Where no weights
    meet all targets at once, the last dimension's are met, and rounds end when they change nothing more."""
    w = weights / weights.sum()
    while True:
        worst, before = 0.0, w
        for at, target in zip(cells, targets, strict=True):
            now = np.bincount(at, w, len(target))
            scale = np.divide(target, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max()))
            w = w * scale[at]
        if worst < close or np.abs(w - before).max() < close * 1e-3:
            return w


def probabilities(weights: np.ndarray, raked: np.ndarray, budget: float) -> np.ndarray:
    """min(1, f * raked / observed), with f such that budget of the weight is expected."""
    ratio = np.divide(raked, weights / weights.sum(), out=np.zeros_like(raked), where=weights > 0)
    share = weights / weights.sum()
    if budget >= 1 or not len(ratio):
        return np.ones_like(ratio)
    order = np.argsort(-ratio)
    full = np.concatenate([[0.0], np.cumsum(share[order])])
    rest = np.concatenate([np.cumsum((share * ratio)[order][::-1])[::-1], [0.0]])
    for k in range(len(order)):  # the k cells of largest ratio are kept whole
        f = (budget - full[k]) / rest[k] if rest[k] > 0 else 0.0
        if f * ratio[order[k]] <= 1:
            return np.minimum(1.0, f * ratio)
    return np.ones_like(ratio)


def _target(given: dict[str, float] | None, names: list[str], observed: np.ndarray, temper: float) -> np.ndarray:
    if given is None:
        share = np.where(observed > 0, observed, 0.0) ** temper
        share[observed <= 0] = 0
    else:
        share = np.array([given.get(n, 0.0) for n in names], float) * (observed > 0)
    total = share.sum()
    return share / total if total else observed / observed.sum()


def _cells_of_driver(sums: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """Each cell with its mix_probability."""
    cells = sums.orderBy(*DIMENSIONS).collect()
    weights = np.array([r.w for r in cells], float)
    p = np.ones(len(cells))
    if weights.sum() > 0:
        at, shares = [], []
        for d in DIMENSIONS:
            kinds = sorted({r[d] for r in cells})
            place = {n: i for i, n in enumerate(kinds)}
            at.append(np.array([place[r[d]] for r in cells]))
            observed = np.bincount(at[-1], weights, len(kinds))
            shares.append(_target(targets.get(d), kinds, observed, TEMPER[d]))
        p = probabilities(weights, rake(weights, at, shares), budget)
    rows = [(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(cells, p, strict=True)]
    return sums.sparkSession.createDataFrame(rows, ", ".join(f"{d} string" for d in DIMENSIONS) + ", mix_probability double")


def _targets_in_spark(sums: DataFrame, d: str, given: dict[str, float] | None) -> DataFrame:
    """Each category of a dimension with its target, as _target has it."""
    observed = sums.groupBy(d).agg(F.sum("w").cast("double").alias("o"))
    if given is None:
        share = observed.withColumn("t", F.when(F.col("o") > 0, F.pow("o", F.lit(TEMPER[d]))).otherwise(0.0))
    else:
        named = sums.sparkSession.createDataFrame([(n, float(x)) for n, x in given.items()], f"{d} string, x double")
        share = observed.join(named, d, "left").withColumn("t", F.when(F.col("o") > 0, F.coalesce("x", F.lit(0.0))).otherwise(0.0))
    t, o = share.agg(F.sum("t"), F.sum("o")).first()
    return share.select(d, (F.col("t") / F.lit(t) if t else F.col("o") / F.lit(o)).alias("target"))


def _cells_in_spark(sums: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]], budget: float, close: float = 1e-10) -> DataFrame:
    """The same by aggregates and joins; only sums reach the driver."""
    total = sums.agg(F.sum("w")).first()[0]
    if not total or budget >= 1:
        return sums.select(*DIMENSIONS, F.lit(1.0).alias("mix_probability"))
    base = sums.select(*DIMENSIONS, (F.col("w") / F.lit(float(total))).alias("share"))
    want = {d: scratch.keep(_targets_in_spark(sums, d, targets.get(d)), f"target-{d}") for d in DIMENSIONS}
    factors = {d: want[d].select(d, F.lit(1.0).alias(f"f_{d}")) for d in DIMENSIONS}

    def raked() -> DataFrame:
        out = base
        for d in DIMENSIONS:
            out = out.join(factors[d], d)
        return out.withColumn("raked", F.col("share") * F.col("f_source") * F.col("f_lang") * F.col("f_topic"))

    k, last = 0, None
    while True:
        k, worst = k + 1, 0.0
        for d in DIMENSIONS:
            now = raked().groupBy(d).agg(F.sum("raked").alias("now"), F.first(f"f_{d}").alias("f")).join(want[d], d)
            scaled = F.when(F.col("now") > 0, F.col("f") * F.col("target") / F.col("now")).otherwise(F.col("f"))
            step = scratch.keep(now.select(d, scaled.alias(f"f_{d}"), F.abs(F.col("now") - F.col("target")).alias("off")), f"factor-{d}-{k % 2}")
            worst = max(worst, step.agg(F.max("off")).first()[0])
            factors[d] = step.drop("off")
        if worst < close or worst == last:  # met, or as far from it as before: no weights meet all targets
            break
        last = worst
    ratio = F.when(F.col("share") > 0, F.col("raked") / F.col("share")).otherwise(0.0)
    cells = scratch.keep(raked().select(*DIMENSIONS, "share", ratio.alias("ratio")), "raked")
    # the cells kept whole become more with each step, until f leaves them as they are
    f, whole = budget, 0
    while True:
        over = F.col("ratio") * F.lit(f) > 1
        full, rest, n = cells.agg(F.sum(F.when(over, F.col("share")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("share") * F.col("ratio"))), F.sum(over.cast("long"))).first()
        if n == whole:
            break
        if rest <= 0:
            return cells.select(*DIMENSIONS, F.when(F.col("ratio") > 0, 1.0).otherwise(0.0).alias("mix_probability"))
        f, whole = (budget - full) / rest, n
    return cells.select(*DIMENSIONS, F.least(F.lit(1.0), F.col("ratio") * F.lit(f)).alias("mix_probability"))


def mix(docs: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED, columns: list[str] | None = None, on_driver: int = CELLS) -> DataFrame:
    """docs (all its columns or those named) with mix_tokens, mix_topic, mix_probability and mix_kept; every row is there."""
    targets = targets or {}
    columns = docs.columns if columns is None else columns
    made = ("mix_tokens", "mix_topic")
    # the id, a stand-in for null ids, and the categories, without texts unless they are asked for
    docs = docs.withColumn("mix_key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    needed = [*columns, "mix_key", *(c for c in ("source", "lang") if c in docs.columns)]
    full = scratch.keep(described(docs, list(dict.fromkeys(needed))), "described")  # one pass over the texts
    names = {"source": "source", "lang": "lang", "topic": "mix_topic"}
    raw = {d: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) if c in full.columns else F.lit(NULL) for d, c in names.items()}
    sums = scratch.keep(full.select(*(raw[d].alias(d) for d in DIMENSIONS), "mix_tokens").groupBy(*DIMENSIONS).agg(F.sum("mix_tokens").alias("w")), "sums")
    if sums.count() <= on_driver:
        table = F.broadcast(_cells_of_driver(sums, targets, budget))
    else:
        table = scratch.keep(_cells_in_spark(sums, scratch, targets, budget), "cells")
    cell = {d: f"mix_{d}_cell" for d in DIMENSIONS}
    for d in DIMENSIONS:
        full, table = full.withColumn(cell[d], raw[d]), table.withColumnRenamed(d, cell[d])
    full = full.join(table, [*cell.values()], "left").drop(*cell.values())
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_key"), 11) / F.lit(float(1 << 53))
    full = full.withColumn("mix_kept", draw < F.coalesce("mix_probability", F.lit(1.0)))
    return full.select(*(c for c in columns if c not in made), *made, "mix_probability", "mix_kept")
