"""Quality classifier by co-training two views of a document.

One view sees the text (shares of character classes and bytes, repetition, word shapes), the other
the metadata (language, source, length). Each is a logistic model. From a bounded sample of
labelled rows (LABELLED) both are fitted; over ROUNDS each scores every unlabelled document, and of
those it is sure of (SURE, on calibrated probabilities) the GIVE surest of each class become
pseudo-labels for the other, in which they stay; a task sends its own GIVE surest, whatever its size. A held-out quarter of the labels then calibrates each
view and the weights with which the two combine; the combined model scores every document. A
view that is never sure, since its features say little, gives no labels and gets little weight.

A document is rejected if its probability of good quality is under KEEP. Without labels of both
classes every document is kept with a null score. Null texts count as empty, other nulls as a
category of their own; labels that are null or of unknown documents are not used. Repeated rows
get equal scores. An empty table gives no rows. Columns of docs are kept, but for score columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, SPACE, Scratch, column, range_hash, raw_texts, words_of

LABELLED, ROUNDS, GIVE, SURE, KEEP = 6000, 4, 200, 0.98, 0.5
LANGS, SOURCES = 16, 64
SCORES = "text_score double, meta_score double, quality_score double, quality_keep boolean"


def text_features(text: np.ndarray) -> np.ndarray:
    """Shares of byte values, and measures of case, symbols, repetition and words."""
    n = len(text)
    if not n:
        return np.zeros(128 + 14)
    counts = np.bincount(text, minlength=256).astype(float)
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum()
    digits, space = counts[48:58].sum(), counts[SPACE].sum()
    symbols = n - upper - lower - digits - space
    stops = counts[[33, 44, 46, 58, 59, 63]].sum()
    start, end = words_of(text)
    w = max(1, len(start))
    hashes = range_hash(_BYTE[text], start, end) if len(start) else np.empty(0, np.uint64)
    size = end - start
    distinct = len(np.unique(hashes)) / w
    again = float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0
    last = text[end - 1] if len(end) else text[:0]
    ends_odd = float(np.isin(last, np.frombuffer(b"!#$%&*|=~^@", np.uint8)).mean()) if len(end) else 0.0
    lone = float((size == 1).mean()) if len(size) else 0.0
    bytes_ = np.sqrt(counts[:128] / n)
    more = [upper / n, upper / (upper + lower + 1), symbols / n, (symbols - stops) / n, digits / n, space / n, distinct, distinct * min(1.0, 50 / w), again, ends_odd, lone, float(size.mean()) / 10 if len(size) else 0.0, min(3.0, float(size.std()) / 10) if len(size) else 0.0, np.log1p(w) / 10]
    return np.concatenate([bytes_, more])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 4)
    out[zlib.crc32((lang or "~null").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "~null").encode()) % SOURCES] = 1
    size = np.log1p(max(0, n_chars or 0)) / 10
    out[-4:] = size, size**2, n_chars is None, size < 0.4
    return out


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25):
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-6, x.std(0), 1.0)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -15, 15)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """Two calibrated views and their combination. labelled: features of each view by row.

    surest(model, rounds so far) gives, for each view and class, the documents it is surest of, best
    first, as (id, label, features of either view).
    """

    def __init__(self, labelled: list[np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS):
        held = np.arange(len(y)) % 4 == 3
        if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
            held = np.zeros(len(y), bool)  # too few labels to hold any out
        own = [[x[~held], y[~held]] for x in labelled]
        taken: set[int] = set()
        self.given = [0, 0]
        for k in range(rounds + 1):
            self.models = [Logistic(x, t) for x, t in own]
            self._calibrate([x[held] if held.any() else x for x in labelled], y[held] if held.any() else y)
            if k == rounds:
                break
            gifts = surest(self, taken)
            for v, gift in enumerate(gifts):
                new = [g for g in gift if g[0] not in taken]  # a document that both are sure of counts once
                taken |= {g[0] for g in new}
                self.given[v] += len(new)
                if new:
                    own[1 - v][0] = np.concatenate([own[1 - v][0], [g[2][1 - v] for g in new]])
                    own[1 - v][1] = np.concatenate([own[1 - v][1], [g[1] for g in new]])
            if not any(gifts):
                break

    def _calibrate(self, views: list[np.ndarray], y: np.ndarray) -> None:
        logits = [m.logit(x) for m, x in zip(self.models, views, strict=True)]
        self.scaling = [Logistic(z[:, None], y, 1e-2) for z in logits]
        both = np.column_stack([s.logit(z[:, None]) for s, z in zip(self.scaling, logits, strict=True)])
        self.combined = Logistic(both, y, 1e-2)

    def view(self, v: int, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaling[v].logit(self.models[v].logit(x)[:, None]))

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [s.logit(m.logit(x)[:, None]) for s, m, x in zip(self.scaling, self.models, views, strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.combined.logit(np.column_stack(z)))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    text = np.array([text_features(t) for t in raw_texts(column(batch, "text"))]).reshape(batch.num_rows, -1)
    meta = [column(batch, n).to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in ("lang", "source", "n_chars")]
    return [text, np.array([meta_features(*m) for m in zip(*meta, strict=True)]).reshape(batch.num_rows, -1)]


def surest_of(features: DataFrame, scratch: Scratch):
    """The function that CoTrained asks; features: row, a, b (features of the views as bytes) of every document."""

    def ask(model: CoTrained, taken: set[int]):
        past = np.array(sorted(taken), np.int64)

        def run(batches):
            best: dict[tuple[int, int], list] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = column(batch, "row").to_numpy()
                free = ~np.isin(ids, past)
                for v, name in enumerate("ab"):
                    p = model.view(v, unpacked(column(batch, name)))
                    for c, sure in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(free & (sure >= SURE))
                        best[v, c] = sorted({*best[v, c], *zip((-sure[at]).tolist(), ids[at].tolist(), strict=True)})[:GIVE]
            out = [(v, c, *f) for (v, c), found in best.items() for f in found]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["view", "label", "unsure", "row"])

        found = scratch.keep(features.mapInArrow(run, "view int, label int, unsure double, row long").distinct(), "surest")
        top = [(v, c, [r.row for r in found.where((F.col("view") == v) & (F.col("label") == c)).orderBy("unsure", "row").limit(GIVE).collect()]) for v in (0, 1) for c in (1, 0)]
        wanted = sorted({r for _, _, rows in top for r in rows})
        views = {r.row: [unpacked([x])[0] for x in (bytes(r.a), bytes(r.b))] for r in features.where(F.col("row").isin(wanted)).dropDuplicates(["row"]).collect()} if wanted else {}
        return [[(r, float(c), views[r]) for w, c, rows in top if w == v for r in rows] for v in (0, 1)]

    return ask


def unpacked(rows) -> np.ndarray:
    raw = [r.as_py() if isinstance(r, pa.Scalar) else r for r in rows]
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """A model from at most `labelled` rows with labels, those of least hash of the id, and all others without."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    names = [n for n in ("text", "lang", "source", "n_chars") if n in docs.columns]

    def featured(batches):
        for batch in batches:
            views = _views(batch)
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "doc_id").cast(pa.int64()), *(pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary()) for v in views)], names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.xxhash64(F.isnull("doc_id"), "doc_id", *names).alias("row"), "doc_id", *names)
    features = scratch.keep(rows.mapInArrow(featured, "row long, doc_id long, a binary, b binary"), "features")
    ids = features.select("doc_id").where("doc_id is not null").distinct()
    chosen = ids.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = sorted({(r.doc_id, r.y, bytes(r.a), bytes(r.b), r.row) for r in features.join(F.broadcast(chosen), "doc_id").collect()}, key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    y = np.array([float(r[1] > 0) for r in known])
    if len(np.unique(y)) < 2:
        return None
    ask, own = surest_of(features.select("row", "a", "b"), scratch), {r[4] for r in known}
    return CoTrained([unpacked([r[i] for r in known]) for i in (2, 3)], y, lambda model, taken: ask(model, taken | own), rounds)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep: float = KEEP, columns: list[str] | None = None, **bounds: int) -> DataFrame:
    """docs (all its columns or those named) with text_score, meta_score, quality_score, quality_keep; every row is there."""
    added = [x.split()[0] for x in SCORES.split(", ")]
    docs = docs.select(*(c for c in docs.columns if c not in added))
    model = train(docs, labels, scratch, **bounds)
    columns = docs.columns if columns is None else columns
    schema = docs.select(*columns).schema
    for x in SCORES.split(", "):
        schema = schema.add(*x.split())

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if model is None or not n:
                scores = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n, pa.bool_())]
            else:
                text, meta, both = model.score([v.astype(np.float32).astype(float) for v in _views(batch)])
                scores = [pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= keep)]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in columns), *scores], names=[*columns, *added])

    return docs.mapInArrow(run, schema)
