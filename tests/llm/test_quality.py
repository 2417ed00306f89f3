import random

import numpy as np

from tidemark.llm.common import Scratch
from tidemark.llm.quality import CoTrained, Logistic, classify, sigmoid, text_features


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 3))
    y = (rng.random(4000) < sigmoid(x @ [2, -1, 0] + 0.5)).astype(float)
    z = Logistic(x, y, 1e-3).logit(np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]))
    assert np.allclose([z[0], z[1] - z[0], z[2] - z[0]], [0.5, 2, -1], atol=0.25)


def test_a_weak_view_learns_from_the_other():
    """Few labels: view b gains from what view a is sure of."""
    rng = np.random.default_rng(1)
    n = 4000
    y = (rng.random(n) < 0.5).astype(float)
    a = np.column_stack([y * 6 - 3 + rng.standard_normal(n), rng.standard_normal(n)])
    b = np.column_stack([y * 1.5 + rng.standard_normal(n), rng.standard_normal((n, 30))])
    few = slice(0, 48)

    def surest(model, taken):
        out = []
        for v in (0, 1):
            p = model.view(v, (a, b)[v][48:2000])
            free = np.array([i not in taken for i in range(48, 2000)])
            out.append([(int(i) + 48, c, [a[i + 48], b[i + 48]]) for c, s in ((1.0, p), (0.0, 1 - p)) for i in np.argsort(-s)[:100] if free[i] and s[i] >= 0.98])
        return out

    model = CoTrained([a[few], b[few]], y[few], surest)
    alone = Logistic(b[few], y[few])
    test = slice(2000, n)
    assert model.given[0] > 50
    assert ((model.view(1, b[test]) > 0.5) == y[test]).mean() > ((alone.logit(b[test]) > 0) == y[test]).mean() + 0.02
    assert ((model.score([a[test], b[test]])[2] > 0.5) == y[test]).mean() > 0.98


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in classify(docs, seen, Scratch(spark), columns=["doc_id"]).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([r.quality_keep == bool(q) for r, q in held]) > 0.95
    assert np.mean([r.quality_keep for r, q in held if q]) > 0.99


def test_pseudo_labels_come_from_all_documents(spark):
    """The surest of every task are compared as a whole, whatever the number of tasks."""
    from tidemark.llm.quality import GIVE, SURE, surest_of

    rng = np.random.default_rng(4)
    x = rng.uniform(-8, 8, (1500, 2)).astype(np.float32)

    class Model:
        def view(self, v, f):
            return sigmoid(f[:, v])

    df = spark.createDataFrame([(i, r[:1].tobytes() + r[1:].tobytes(), r[::-1].tobytes()) for i, r in enumerate(x)], "row long, a binary, b binary").repartition(7)
    taken = set(range(0, 1500, 3))
    for v, gift in enumerate(surest_of(df, Scratch(spark))(Model(), taken)):
        p = Model().view(v, (x, x[:, ::-1])[v].astype(float))
        want = [(i, c) for c, s in ((1.0, p), (0.0, 1 - p)) for i in sorted((i for i in range(1500) if i not in taken and s[i] >= SURE), key=lambda i: (-s[i], i))[:GIVE]]
        assert [(r, c) for r, c, _ in gift] == want and all(np.array_equal(f[0], x[r]) for r, _, f in gift)


def test_features_of_odd_texts():
    for t in (b"", b" ", b"a", b"\n\n", b"a" * 100_000, bytes(range(256))):
        f = text_features(np.frombuffer(t, np.uint8))
        assert f.shape == (142,) and np.isfinite(f).all()


def test_edge_tables(spark):
    rng = random.Random(0)
    rows = [(i, " ".join("ok fine words here".split() if i % 2 else ["JUNK!!"] * rng.randint(3, 9)), None, None, None, 1.0) for i in range(60)]
    rows += [(None, None, "en", "s", 3, 1.0), (1, rows[1][1], None, None, None, 1.0), (99, "", "en", "s", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, 0), (5000, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, Scratch(spark)).collect()
    assert len(got) == len(rows) and {r.quality_keep for r in got if r.doc_id is not None and 40 <= r.doc_id < 60 and r.doc_id % 2 == 0} == {False}
    assert all(r.quality_keep for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2)
    none = classify(docs, labels.where("quality = 1"), Scratch(spark)).collect()
    assert all(r.quality_keep and r.quality_score is None for r in none)
    assert classify(docs.limit(0), labels, Scratch(spark)).count() == 0
