import numpy as np
import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.itq import bits_apart, chunks, codes, fitted, learn, near_vectors


def brute(rows, cosine=0.95):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for i, a in ok:
        for j, b in ok:
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i].add(j)
    root = {}
    for i in sorted(links):
        if i in root:
            continue
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        root |= dict.fromkeys(seen, i)
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


def fixture(n=400, dims=64):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    for i in range(0, 200):  # families around few centres, at cosines from 0.9 to 1
        y = rng.standard_normal(dims)
        x[i] = x[300 + i % 7] + y * rng.uniform(0.02, 0.35)
    x[210:220] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * dims), (n + 3, [float("nan")] + [1.0] * (dims - 1)), (n + 4, [None] + [1.0] * (dims - 1)), (n + 5, [float("inf")] + [1.0] * (dims - 1)), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]


def test_finds_the_links_of_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors(df, Scratch(spark)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert got[406][0] == got[407][0] == 1 and got[407][1] == 406


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_sample_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(x[lo : lo + 1024] @ x.T >= 0.95).sum(1) - 1 for lo in range(0, len(x), 1024)])
    got = {r.vec_id: r.n_links for r in near_vectors(df, Scratch(spark)).collect()}
    found = np.array([got[i] for i, _ in rows])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_bits_are_balanced():
    x = np.random.default_rng(0).standard_normal((2000, 32)) + 3
    c = codes(x, *learn(x, 2), 2)
    bits = np.unpackbits(c.view(np.uint8).reshape(2000, -1), axis=1).mean(0)
    assert ((bits == 0) | (np.abs(bits - 0.5) < 0.1)).all()


def test_rows_that_share_an_id_keep_their_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [-1.0, -1.0]), (None, [1.0, 0.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + k, [1.0 + k / 100] + [0.5] * (n - 1)) for n in range(1, 25) for k in range(2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark)).collect()}
    assert got == {i: (1, i - i % 2) for i, _ in rows}


@pytest.mark.parametrize("rows", [[], [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]])
def test_edge_tables(spark, rows):
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Scratch(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept and r.component_id == r.vec_id


def shifted(n, offset, dims=64, seed=5):
    """Vectors with a common direction; the second half at cosines 0.95 to 0.98 from the first."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) + offset * np.ones(dims)
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((n, dims))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = rng.uniform(0.951, 0.98, n)[:, None]
    return np.concatenate([x, c * x + np.sqrt(1 - c**2) * away])


@pytest.mark.parametrize("offset", [0, 1, 2, 3])
def test_rotations_are_enough_for_a_common_direction(offset):
    x = shifted(3000, offset)
    centre, projection, rotations, radius = fitted(x[::2], 0.95, 2, 44)
    a, b = (codes(v, centre, projection, rotations) for v in (x[:3000], x[3000:]))
    found = (bits_apart(chunks(a), chunks(b)) <= 1).any(1) & (bits_apart(a, b).sum(1, dtype=int) <= radius)
    assert found.mean() >= 0.97


def test_finds_links_of_vectors_with_a_common_direction(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(shifted(300, 2))]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark)).collect()}
    want = brute(rows)
    assert all(got[i] <= want[i][0] for i in want) and sum(got.values()) >= 0.97 * sum(w[0] for w in want.values())
