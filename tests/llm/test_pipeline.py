"""Each stage of the pipeline against a plain version, on the stage's own input."""

import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from test_minhash import brute as near_brute
from test_minhash import shingles
from test_repeats import brute as repeat_brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    scratch, out = Scratch(spark), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(scratch.keep(stage(spark, out[-1], SF), f"s{k}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_filters_return_rows_of_their_input(tables):
    for k in (1, 2, 4):
        before, after = rows(tables[k - 1]), rows(tables[k])
        assert tables[k].columns == cp.COLUMNS and 0 < len(after) <= len(before)
        assert all(before[d] == r for d, r in after.items())


def test_quality_rejects_junk_alone(spark, tables):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(tables[1])
    assert all(d in kept for d, q in labels.items() if q)
    assert sum(d in kept for d, q in labels.items() if not q) <= 2


def test_one_of_each_group_of_near_copies_stays(tables):
    want = {d for d, _, _, kept in near_brute([(r.doc_id, r.text) for r in tables[1].collect()], cp.NEAR) if kept}
    assert set(rows(tables[2])) == want


def test_repeats_are_cut(tables):
    before = {r[0]: r for r in repeat_brute([(r.doc_id, r.text) for r in tables[2].collect()], 200)}
    after = rows(tables[3])
    assert set(after) == set(before)
    for d, r in after.items():
        _, n, removed, _, _ = before[d]
        assert r.n_chars == len(r.text) and 0 <= n - removed - len(r.text.encode()) <= 6 * before[d][3]


def test_packing_holds_every_id(tables):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in tables[5].collect():
        pieces.setdefault(p.doc_id, []).append(p)
    docs = rows(tables[4])
    assert set(pieces) == set(docs)
    for d, ps in pieces.items():
        ids = np.array(t.encode(docs[d].text, add_special_tokens=False).ids + [0], "<u4")
        assert sum(p.length for p in ps) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in ps)


def test_run_gives_the_last_stage(spark, tables):
    got = cp.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in tables[5].collect())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_copies_from_080_on_are_dropped(spark):
    """The sample table and planted pairs of 180 shared shingles of 220, against all pairs at 0.8."""
    rng = np.random.default_rng(7)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").distinct().collect()]
    base = max(d for d, _ in docs) + 1
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(204)]
        other = list(words)
        for i in rng.choice(np.arange(6, 198, 6), 4, replace=False):
            other[i] = f"v{k}y{i}"
        docs += [(base + 2 * k, " ".join(words)), (base + 2 * k + 1, " ".join(other))]
    sets, root = [(d, shingles(t)) for d, t in docs], {d: d for d, _ in docs}
    for (a, s), (b, t) in combinations(sets, 2):
        if s & t and 10 * len(s & t) >= 8 * len(s | t):
            x, y = sorted((root[a], root[b]))
            root = {d: x if r == y else r for d, r in root.items()}
    want = {d for d, r in root.items() if d == r}
    assert not want & {base + 2 * k + 1 for k in range(60)}
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(rows(cp.near_dedup(spark, df, SF))) == want


def test_near_dedup_keeps_every_other_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, "x y z"), (8, None), (8, "")]
    df = spark.createDataFrame([(d, t, None, "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, df, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (5, b), (7, c), (0, "x y z"), (8, ""), (8, "")])
