import random
from itertools import combinations

import numpy as np

from tidemark.llm.common import Scratch, components
from tidemark.llm.minhash import near_duplicates, shingle_sets, signatures

OWN = ["original", "uid"]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        both = len(s & t)
        if both and 100 * both >= percent * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def fixture(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 6)))
    texts = [None, "", " \n", "a b", "A b", "a b c", "one two three four five", "one two three four five six", "\x0b a\x0cb", "a\x85b c d e f g"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 20, 60, 200, 400]))]
        texts.append(" ".join(base))
        chain = list(base)
        for _ in range(rng.randint(0, 9)):  # each a step further from the base
            if rng.random() < 0.5:
                chain = list(base)
            for _ in range(max(1, len(base) // rng.choice([50, 60, 150]))):
                chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain).upper() if rng.random() < 0.3 else "  ".join(chain))
        texts += [texts[-1]] * rng.randint(0, 3)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n_shingles int")
        got = sorted(tuple(r) for r in near_duplicates(df, Scratch(spark)).drop(*OWN).collect())
        assert got == brute(rows)


def test_sample_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in near_duplicates(df, Scratch(spark)).drop(*OWN).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_crowded_bucket_of_several_components(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # similar to the base by about 0.6 to 0.9, to each other by less
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(120)] = f"v{rng.random()}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).drop(*OWN).collect())
    assert got == brute(rows)


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1838], rng.integers(0, 2**63, 162).astype(np.uint64)])
    s = signatures([np.unique(a), np.unique(b)] * 2)
    assert np.array_equal(s[0], s[2]) and 2 <= np.count_nonzero(s[0] != s[1]) <= 22


def test_sets_of_a_block():
    texts = [b"a b c d e f a b c d e", b"", b"x", b"a b c d e"]
    bounds = np.cumsum([0, *map(len, texts)])
    got = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), bounds, 5)
    assert [len(g) for g in got] == [len(shingles(t.decode())) for t in texts] and got[3][0] in got[0]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    nodes = list(range(200))
    rng.shuffle(nodes)
    edges = [*zip(nodes[:80], nodes[1:80], strict=False), *((nodes[100], n) for n in nodes[101:150])]
    got = dict(components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {n: min(nodes[:80]) for n in nodes[:80]} | {n: min(nodes[100:150]) for n in nodes[100:150]}


def test_nulls_repeats_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (1, None), (None, "x y"), (None, "x y")], "doc_id long, text string")
    got = near_duplicates(df, Scratch(spark)).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None].count((None, True)) == 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None].count((2, False)) == 1
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == [(1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True)]
    assert sum(r.original for r in got) == 3 and len({r.uid for r in got}) == 6
    assert near_duplicates(df.limit(0), Scratch(spark)).count() == 0
    assert near_duplicates(df.limit(0), Scratch(spark), carry=[]).count() == 0


def test_an_id_with_several_texts_and_a_very_long_one(spark):
    rng = random.Random(3)
    text = [" ".join(f"{k}{rng.random()}" for _ in range(30)) for k in "abc"]
    long = " ".join(rng.choices("abcdefghijklmnop", k=300_000))
    rows = [(1, text[0]), (5, text[0]), (5, text[1]), (7, text[2]), (7, text[2]), (None, text[0]), (9, text[1]), (10, long), (11, long + " z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, Scratch(spark)).collect()}
    assert got == {(1, 1, True), (5, 1, False), (5, 5, True), (7, 7, True), (None, 1, False), (9, 5, False), (10, 10, True), (11, 10, False)}
    left = near_duplicates(df, Scratch(spark), carry=[]).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, text[0]), (5, text[1]), (7, text[2]), (10, long)]
