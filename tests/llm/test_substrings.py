import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.substrings import FingerprintIndex, remove_seen


def brute(rows, window):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def fixture(window, seed=0):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choices(["the", "an", "er", "on", "é", "ti", "x\x0by", "z\x1cq"], k=n))
    shared = [prose(window), prose(window // 2), prose(window * 3)]
    texts = [None, "", "short", "a b " * window, "x\n" * (window * 3), " y" * (window + 1), "z " * window]
    for _ in range(60):
        t = prose(rng.randint(0, window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split(" ")
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "#"
            t += rng.choice([" ", "\n", " \t"]).join([*p, prose(rng.randint(0, window))]) + " "
        texts.append(t)
    texts += [texts[10], texts[10], texts[20]]
    rng.shuffle(texts)
    return [(3 * i - 50, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("window, gram, batches", [(6, 2, 4), (20, 5, 3), (20, 5, 1)])
def test_equals_brute_force(spark, window, gram, batches):
    rows = fixture(window)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = remove_seen(df, Scratch(spark), window, gram, batches).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, window)


def test_sample_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = remove_seen(df, Scratch(spark)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in df.collect()], 20)


def test_runs_are_compacted_and_opened_again(spark):
    scratch = Scratch(spark)
    index = FingerprintIndex(spark, f"{scratch.base}/index", 4, 2)
    for k in range(4):
        df = spark.createDataFrame([(k, k, k, f"a b c d e f{k} g h")], "row long, doc long, doc_id long, text string")
        places = index.add(df)
        assert {(r.row, r.loc // 65536) for r in places.collect()} <= ({(k, 0), (k, 1)} if k else set())
        assert [[level for level, _ in index.runs[kind]] for kind in ("anchors", "windows")] == [[[0], [1], [1, 0], [2]][k]] * 2
        index.close()
        index = FingerprintIndex.open(spark, index.path)
    (_, name), (_, windows) = index.runs["anchors"][0], index.runs["windows"][0]
    rows = index.anchors(name).collect()
    assert len({r.a for r in rows}) == len(rows) and any(r.mixed for r in rows)
    found = index.windows(windows).collect()
    assert len({(r.w, r.v) for r in found}) == len(found)
    plan = index.anchors(name)._jdf.queryExecution().toString()
    assert index.anchors(name).join(index.anchors(name).withColumnRenamed("s", "x"), "a").select("s", "x")._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 0, plan


def brute_rows(rows, window):
    """As remove_seen has it for null ids and ids with several texts: only smaller ids, or the own row, come before."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, float("inf")), key(d))
    out = []
    for d, w in words:
        gone, own = np.zeros(len(w), bool), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in own or first[x] < key(d):
                gone[i : i + window] = True
            own.add(x)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, A), (None, A), (None, B)],
        [(None, A), (None, A)],
        [(1, A), (2, A), (2, B)],
        [(1, A), (1, B), (1, f"{A} {B}"), (1, f"x {A} y {A}")],
        [(5, A), (5, f"{B} q {B}"), (6, f"{B[:-4]} r {A}"), (None, f"{A} {B}"), (2**63 - 1, B), (-(2**63), "z")],
    ],
)
def test_null_ids_and_ids_with_several_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, remove_seen(df, Scratch(spark)).drop("kept").collect()), key=order) == sorted(brute_rows(rows, 20), key=order)


def test_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(rng.choices(["ab", "cd", "ef"], k=400_000))
    rows = [(1, long), (2, long[:100_000]), (3, "new " * 3)]
    got = remove_seen(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute_rows(rows, 20))


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None)], "doc_id long, text string")
    got = remove_seen(df, Scratch(spark)).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 0), (9, 30)]
    assert remove_seen(df.limit(0), Scratch(spark)).count() == 0
