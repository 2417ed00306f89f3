"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Equal vectors collapse to one class by a map-side aggregate. On a bounded sample (SAMPLE vectors,
the rows of least hash) rotations are learned so that the signs of rotated, centred vectors are
balanced bits with little quantisation loss. A code of 64 bits for each rotation is cut into chunks of
CHUNK bits, one table each; a vector is looked up in a table under its chunk and under the chunk
with each one bit flipped. A pair that several tables find counts in the first of them only.

Retrieval runs on ids and codes and keeps, for each table bucket, the members that meet a partner
within RADIUS bits of the whole code. Only for those are vectors sent, and cosines computed in
double precision in the bucket: links are summed per vector there, and links within a bucket
shrink to a forest, so no list of all pairs exists. A bucket too large for a task is cut into
parts of queries.

Vectors that share a strong direction have wider angles once centred. So pairs at exactly the cosine
asked for are made around sample vectors, in random directions and in those between sample vectors, and
rotations are added, and the radius widened, until RECALL of either kind is found. Where MOST rotations
don't reach that, codes are of vectors that aren't centred, whose bits change with the angle alone: their
buckets are larger.

A pair counts as found if its codes agree in a table but for one bit and lie within the radius as a whole:
the same rule for links and components, whichever table it is met in.

Classes have numbers of their own, so rows that share a vec_id keep their own links. Vectors that are
null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
vec_id, whose component is null. Vectors of different lengths never link; each length has a model
of its own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, column, components, forest, mix

COSINE, SAMPLE, ROUNDS, ROTATIONS, CHUNK, RADIUS = 0.95, 20_000, 30, 2, 16, 44
#: Of pairs at exactly the cosine asked for, the share that the tables find; and rotations of centred vectors.
RECALL, MOST = 0.98, 24
#: Queries of a bucket that one task compares with all of the bucket.
PART = 2048
_SALT = np.uint64(0x9E3779B97F4A7C15)


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS, seed: int = 11, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dims x bits): alternately bits from rotated data and the best rotation for the bits."""
    dims = sample.shape[1]
    bits = min(64, dims)
    rng = np.random.default_rng(seed)
    centre = sample.mean(0) if len(sample) and centred else np.zeros(dims)
    x = sample - centre
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(dims))
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds if len(sample) else 0):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return centre, np.concatenate(out, axis=1)


def codes(x: np.ndarray, centre: np.ndarray, projection: np.ndarray, rotations: int) -> np.ndarray:
    """One row of 64-bit words per vector, a word per rotation."""
    signs = ((x - centre) @ projection >= 0).reshape(len(x), rotations, -1)
    wide = np.zeros((len(x), rotations, 64), np.uint8)
    wide[:, :, : signs.shape[2]] = signs
    return np.packbits(wide, axis=2, bitorder="little").reshape(len(x), rotations, 8).copy().view("<u8").reshape(len(x), rotations)


def chunks(code: np.ndarray, width: int = CHUNK) -> np.ndarray:
    parts = [(code >> np.uint64(s)) & np.uint64((1 << width) - 1) for s in range(0, 64, width)]
    return np.stack(parts, axis=2).reshape(len(code), -1)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def pairs_at(sample: np.ndarray, cosine: float, n: int = 2000, seed: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sample vectors and others at exactly the cosine from them: in any direction, and as sample vectors differ."""
    rng = np.random.default_rng(seed)
    pick = lambda: sample[rng.integers(0, len(sample), n)]
    out = []
    for away in (rng.standard_normal((n, sample.shape[1])), pick() - pick()) if len(sample) else ():
        x = pick()
        away = away - (away * x).sum(1)[:, None] * x
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-6
        if some.any():
            x, away = x[some], away[some] / size[some, None]
            out.append((x, cosine * x + np.sqrt(1 - cosine**2) * away))
    return out


def fitted(sample: np.ndarray, cosine: float, rotations: int, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Centre, projection, rotations and radius that find RECALL of the pairs at the cosine."""
    pairs, bits = pairs_at(sample, cosine), min(64, sample.shape[1])
    for centred, most in ((True, rotations), (True, MOST), (False, MOST)):
        centre, projection = learn(sample, most, centred=centred)
        coded = [(codes(x, centre, projection, most), codes(y, centre, projection, most)) for x, y in pairs]
        for r in range(rotations, most + 1):
            found, reach = [], radius * r // rotations
            for a, b in coded:
                apart = bits_apart(a[:, :r], b[:, :r]).sum(1, dtype=np.int64)
                reach = max(reach, int(np.quantile(apart, 0.999)))
                found.append(float((bits_apart(chunks(a[:, :r]), chunks(b[:, :r])) <= 1).any(1).mean()))
            if min(found, default=1.0) >= RECALL:
                return centre, projection[:, : r * bits], r, reach
    return centre, projection, most, reach


def unit_rows(arr: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Per row its length or -1 if it can't link, and by length the unit vectors of those rows."""
    rows = arr.to_pylist()
    size = np.full(len(rows), -1)
    found: dict[int, list] = {}
    for i, r in enumerate(rows):
        if not r or any(v is None for v in r):
            continue
        v = np.asarray(r, np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            continue
        v = v / top
        size[i] = len(r)
        found.setdefault(len(r), []).append(v / np.linalg.norm(v))
    return size, {n: np.array(v) for n, v in found.items()}


def _units(batches):
    """The unit form of vectors that can link, as bytes; null of others."""
    for batch in batches:
        size, found = unit_rows(column(batch, "embedding"))
        at = {n: iter(v) for n, v in found.items()}
        ids, units = column(batch, "vec_id"), []
        for n, known in zip(size.tolist(), ids.is_valid().to_pylist(), strict=True):
            unit = next(at[n]) if n > 0 else None
            units.append(unit.tobytes() if n > 0 and known else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "dims", "unit"])


def _lookups(models: dict[int, tuple[np.ndarray, np.ndarray, int]], rotations: int):
    """(key, rep, query, c0..): the bucket of each chunk, and as a query those one flip away as well."""

    def run(batches):
        for batch in batches:
            ids, dims, unit = column(batch, "rep").to_numpy(), column(batch, "dims").to_numpy(), column(batch, "unit")
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                x = np.frombuffer(b"".join(unit.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), n)
                code = codes(x, *models[int(n)])
                keys, query = [], []
                for t, c in enumerate(chunks(code).T):
                    place = np.uint64(t) + np.uint64(n) * np.uint64(1 << 20)
                    base = c << np.uint64(40)
                    for flip in [0, 0, *(1 << b for b in range(CHUNK))]:
                        keys.append(mix((base ^ np.uint64(flip << 40)) + place + _SALT))
                        query.append(len(keys) % (CHUNK + 2) != 1)
                k = len(keys)
                cols = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids[at], k)), pa.array(np.repeat(np.array(query), len(at)))]
                code = np.pad(code, ((0, 0), (0, rotations - code.shape[1])))
                cols += [pa.array(np.tile(np.ascontiguousarray(code[:, r]).view(np.int64), k)) for r in range(rotations)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rep", "query", *(f"c{r}" for r in range(rotations))])

    return run


def _split(g: pa.Table, names: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    q = g.column("query").to_numpy()
    cols = [g.column(n).to_numpy() for n in names]
    return [c[q] for c in cols], [c[~q] for c in cols]


def _codes_of(cols: list[np.ndarray]) -> np.ndarray:
    return np.stack([c.view(np.uint64) for c in cols], axis=1)


def _meet(rotations: int, radius: int):
    """Members of a bucket part that meet a partner within the radius: as query, as entry."""
    names = ["rep", *(f"c{r}" for r in range(rotations))]

    def run(batches):
        out, rows = [[], [], []], 0
        for g in by_group(batches, ["key", "part"]):
            q, e = _split(g, names)
            if not len(q[0]) or not len(e[0]):
                continue
            qc, ec = _codes_of(q[1:]), _codes_of(e[1:])
            hit_q, hit_e = np.zeros(len(qc), bool), np.zeros(len(ec), bool)
            for lo in range(0, len(ec), PART):
                apart = sum(bits_apart(qc[:, None, r], ec[None, lo : lo + PART, r]).astype(np.int16) for r in range(rotations))
                close = (apart <= radius) & (q[0][:, None] != e[0][None, lo : lo + PART])
                hit_q |= close.any(1)
                hit_e[lo : lo + PART] |= close.any(0)
            key = g.column("key")[0].as_py()
            for ids, is_query in ((q[0][hit_q], True), (e[0][hit_e], False)):
                out[0].append(np.full(len(ids), key))
                out[1].append(ids)
                out[2].append(np.full(len(ids), is_query))
                rows += len(ids)
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "rep", "query"])
                out, rows = [[], [], []], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "rep", "query"])

    return run


def _rerank(cosine: float, models, radius: int):
    """Per bucket part: each query's weight of links that this table finds first, and a forest of its links."""

    def run(batches):
        for g in by_group(batches, ["key", "part"]):
            (qi, qn, qd, qu), (ei, en, ed, eu) = _split(g, ["rep", "copies", "dims", "unit"])
            if not len(qi) or not len(ei):
                continue
            n = int(qd[0])
            table = _table_of(int(g.column("key")[0].as_py()), n, qu, ei, eu, models)
            qx, ex = (np.frombuffer(b"".join(u), np.float64).reshape(-1, n) for u in (qu, eu))
            q_code, e_code = (codes(x, *models[n]) for x in (qx, ex))
            qc, ec = chunks(q_code), chunks(e_code)
            degree, root = np.zeros(len(qi), np.int64), qi.copy()
            trees = set()
            for lo in range(0, len(ei), PART):
                part = slice(lo, lo + PART)
                link = (qx @ ex[part].T >= cosine) & (qi[:, None] != ei[None, part])
                if not link.any():
                    continue
                link &= sum(bits_apart(q_code[:, None, r], e_code[None, part, r]).astype(np.int16) for r in range(q_code.shape[1])) <= radius
                first = np.ones_like(link)
                for t in range(table):
                    x = qc[:, None, t] ^ ec[None, part, t]
                    first &= np.bitwise_count(x) > 1
                degree += (link & first) @ en[part]
                i, j = np.nonzero(link)
                trees |= forest(qi[i], ei[part][j])
            a, b = np.array(sorted(trees), np.int64).reshape(-1, 2).T
            some = degree > 0
            ids = np.concatenate([qi[some], a])
            other = pa.array(np.concatenate([np.zeros(some.sum(), np.int64), b]), mask=np.concatenate([np.ones(some.sum(), bool), np.zeros(len(a), bool)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), other, pa.array(np.concatenate([degree[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"])

    return run


def _table_of(key: int, dims: int, qu, ei, eu, models) -> int:
    """Which table a bucket's key belongs to: that whose chunk of an entry hashes to it."""
    x = np.frombuffer(eu[0], np.float64).reshape(1, dims)
    c = chunks(codes(x, *models[dims]))[0]
    t = np.arange(len(c), dtype=np.uint64)
    keys = mix((c << np.uint64(40)) + t + np.uint64(dims) * np.uint64(1 << 20) + _SALT).view(np.int64)
    return int(np.flatnonzero(keys == key)[0])


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, rotations: int = ROTATIONS, sample: int = SAMPLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = ids.mapInArrow(_units, "vec_id long, dims int, unit binary")
    members = scratch.keep(units.withColumn("class", F.xxhash64("unit")).withColumn("class2", F.xxhash64(F.lit(7), "unit")), "members")
    own = ["class", "class2"]
    classes = members.where("unit is not null").groupBy(*own).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    models, start, widest = {}, rotations, radius
    for n in sorted(r.dims for r in classes.select("dims").distinct().collect()):
        some = classes.where(F.col("dims") == n).orderBy(*own).limit(sample).select("unit").collect()
        *models[n], reach = fitted(np.frombuffer(b"".join(r.unit for r in some), np.float64).reshape(-1, n), cosine, start, radius)
        widest = max(widest, reach)
    rotations = max((m[2] for m in models.values()), default=start)
    code_cols = [f"c{r}" for r in range(rotations)]
    looked = classes.select("rep", "dims", "unit").mapInArrow(_lookups(models, rotations), "key long, rep long, query boolean, " + ", ".join(f"{c} long" for c in code_cols))
    looked = scratch.keep(looked, "looked")

    def dealt(rows: DataFrame) -> DataFrame:
        """Buckets with a query and an entry of different classes; queries in parts, entries to each part."""
        size = rows.groupBy("key").agg(F.sum(F.col("query").cast("long")).alias("nq"), F.sum((~F.col("query")).cast("long")).alias("ne"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
        size = size.where("nq > 0 and ne > 0 and lo <> hi").select("key", F.ceil(F.col("nq") / PART).cast("int").alias("parts"))
        own = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("rep"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = rows.join(size, "key").withColumn("part", F.explode(own)).drop("parts")
        return rows.repartition("key", "part").sortWithinPartitions("key", "part")

    met = dealt(looked).mapInArrow(_meet(rotations, widest), "key long, rep long, query boolean").distinct()
    met = scratch.keep(met, "met")
    sent = dealt(met.join(classes.select("rep", "copies", "dims", "unit"), "rep"))
    found = sent.select("key", "part", "query", "rep", "copies", "dims", "unit").mapInArrow(_rerank(cosine, models, widest), "a long, b long, n long")
    found = scratch.keep(found, "found")
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    trees = scratch.keep(components(scratch, found.where("b is not null").select("a", "b"), "trees"), "roots")
    of_class = classes.select(*own, "rep", "least", "copies").join(degree, "rep", "left").join(trees.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = scratch.keep(of_class.withColumn("component", F.coalesce("component", "rep")), "of_class")
    smallest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(smallest, "component").select(*own, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    scratch.drop("looked", "met")
    # rows that can't link have no class; they keep out of the join, which would bring them all together
    linked = members.where("unit is not null").select("vec_id", *own).join(of_class, own).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(members.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
