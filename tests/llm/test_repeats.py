import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.repeats import remove_repeats, repeated, separated, suffix_order


def brute(rows, length):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture(length, seed=0):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choices(["the ", "an", "er", "on ", "é", "ti", ". "], k=n))
    shared = [prose(length), prose(length // 2), prose(length * 2)]
    texts = [None, "", "short", "ab" * length, "x" * (length * 3), "x" * (length + 1), "y" * length]
    for _ in range(60):
        t = prose(rng.randint(0, length))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            t += p + prose(rng.randint(0, length))
        texts.append(t)
    texts += [texts[10], texts[10], texts[20]]
    return list(enumerate(texts))


@pytest.mark.parametrize("length, gram, crowd", [(40, 8, 1000), (40, 8, 4), (200, 32, 8192), (200, 32, 5)])
def test_equals_brute_force(spark, length, gram, crowd):
    rows = fixture(length)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int")
    got = remove_repeats(df, Scratch(spark), length, gram, crowd).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, length)


def test_sample_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = remove_repeats(df, Scratch(spark)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in df.collect()], 200)


def test_boundaries_are_the_short_common_prefixes():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 5, 9):
        parts = [rng.integers(1, 4, rng.integers(0, 30)) for _ in range(12)]
        parts.append(parts[3])
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int16)
        order, cut = separated(text, depth)
        s = [text[i:].tolist() for i in order]
        assert [x[:depth] for x in s] == sorted(x[:depth] for x in s)
        for a, b, c in zip(s, s[1:], cut[1:], strict=False):
            if 0 not in a[:depth] and 0 not in b[:depth]:
                assert c == (a[:depth] != b[:depth])
    assert sorted(suffix_order(text, 9)) == list(range(len(text)))


def test_repeated_windows_of_parts():
    got = repeated([b"abcdef", b"xbcdez", b"abc", b""], 3)
    assert [g.tolist() for g in got] == [[True, True, True, False], [False, True, True, False], [True], []]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    t = "0123456789" * 3 + "unlike anything else here" + "z" * 9
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None)], "doc_id long, text string")
    got = remove_repeats(df, Scratch(spark), 20, 8).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in got) == [(0, len(t)), (1, len(t)), (1, len(t)), (2, 0)]
    assert remove_repeats(df.limit(0), Scratch(spark)).count() == 0
