import numpy as np
import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.mixing import lexical_topic, mix, probabilities, rake


def test_raking_meets_every_marginal():
    rng = np.random.default_rng(0)
    at = [np.repeat(np.arange(4), 15), np.tile(np.repeat(np.arange(5), 3), 4), np.tile(np.arange(3), 20)]
    targets = [rng.dirichlet(np.ones(n) * 5) for n in (4, 5, 3)]
    w = rng.uniform(1, 100, 60)
    r = rake(w, at, targets)
    for a, t in zip(at, targets, strict=True):
        assert np.allclose(np.bincount(a, r), t, atol=1e-8)
    # interactions stay: odds ratios of a 2 x 2 subtable
    i = [k for k in range(60) if at[2][k] == 0 and at[0][k] < 2 and at[1][k] < 2]
    odds = lambda x: x[i[0]] * x[i[3]] / x[i[1]] / x[i[2]]
    assert np.isclose(odds(w), odds(r))


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 1.0])
def test_probabilities_meet_the_budget(budget):
    rng = np.random.default_rng(1)
    w, r = rng.uniform(1, 9, 30), rng.dirichlet(np.ones(30))
    p = probabilities(w, r, budget)
    assert p.max() <= 1 and np.isclose((p * w).sum() / w.sum(), budget)


def test_topics():
    assert lexical_topic([b"a", b"bb"]) == "none"
    assert lexical_topic([b"zzzzzz", b"aaaaaa"]) == lexical_topic([b"aaaaaa"])


def test_sampled_shares_follow_the_targets(spark):
    rng = np.random.default_rng(2)
    n = 6000
    rows = [(i, "word " * int(rng.integers(5, 30)), "en" if rng.random() < 0.8 else None, "hot" if rng.random() < 0.6 else f"s{rng.integers(0, 4)}", int(rng.integers(0, 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    targets = {"source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.2, "absent": 1.0}, "lang": {"en": 0.5, "~null": 0.5}}
    got = mix(df, Scratch(spark), targets, budget=0.2).collect()
    assert len(got) == n
    kept = [r for r in got if r.mix_kept]
    total = sum(r.mix_tokens for r in kept)
    assert abs(total / sum(r.mix_tokens for r in got) - 0.2) < 0.02
    for s in ("hot", "s0", "s3"):
        assert abs(sum(r.mix_tokens for r in kept if r.source == s) / total - 0.2) < 0.04
    assert abs(sum(r.mix_tokens for r in kept if r.lang is None) / total - 0.5) < 0.05
    # a brute-force raking of the same cells gives the same probabilities
    keys = sorted({(r.source, r.lang or "~null", str(r.topic)) for r in got})
    w = np.array([sum(r.mix_tokens for r in got if (r.source, r.lang or "~null", str(r.topic)) == k) for k in keys], float)
    x = w / w.sum()
    topic = {t: sum(x[i] for i, k in enumerate(keys) if k[2] == t) for t in "012"}
    for _ in range(300):
        for d, t in enumerate(({s: 0.2 for s in ("hot", "s0", "s1", "s2", "s3")}, {"en": 0.5, "~null": 0.5}, topic)):
            now = {c: sum(x[i] for i, k in enumerate(keys) if k[d] == c) for c in t}
            x = np.array([x[i] * t[k[d]] / now[k[d]] for i, k in enumerate(keys)])
    f = x / (w / w.sum())
    want = dict(zip(keys, f, strict=True))
    some = [(r.mix_probability, want[r.source, r.lang or "~null", str(r.topic)]) for r in got]
    low = [(a, b) for a, b in some if a < 1]
    assert np.std([a / b for a, b in low]) < 1e-6 * np.mean([a / b for a, b in low]) + 1e-9


def test_nulls_repeats_clashing_names_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, None, 5), (1, "a b", "en", "s", 5), (1, "a b", "en", "s", 5), (2, "long words " * 100_000, "en", None, 5)], "doc_id long, text string, lang string, source string, mix_tokens int")
    got = mix(df, Scratch(spark)).collect()
    assert sorted(r.mix_tokens for r in got) == [0, 2, 2, 200_000]
    assert len({r.mix_kept for r in got if r.doc_id == 1}) == 1
    assert mix(df.limit(0), Scratch(spark)).count() == 0


def test_every_source_has_a_target_of_its_own(spark):
    """Equal sources are kept alike, however many there are."""
    rows = [(i, "word " * 10, "en", f"s{i % 400:03d}") for i in range(800)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark), budget=0.3).collect()
    assert len(got) == 800 and all(np.isclose(r.mix_probability, 0.3) for r in got)


@pytest.mark.parametrize("targets", [None, {"source": {"s0": 0.6, "s1": 0.2, "absent": 1.0}}])
def test_cells_in_spark_have_the_probabilities_of_the_driver(spark, targets):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.integers(0, 30)), None if rng.random() < 0.3 else "en", f"s{int(rng.integers(0, 5) * rng.random())}", int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    one, two = ({r.doc_id: r.mix_probability for r in mix(df, Scratch(spark), targets, budget=0.5, columns=["doc_id"], on_driver=n).collect()} for n in (1000, 0))
    assert set(one) == set(two) and max(abs(one[i] - two[i]) for i in one) < 1e-8
