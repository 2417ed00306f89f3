import random

import numpy as np

from tidemark.llm.licenses import SIMILAR, TEMPLATES, Index, align, diagonals, grams, scan, scan_licenses, winnow, words

LINES = {k: v for k, v in TEMPLATES.items() if k.endswith("-line")}


def common_run(a, b):
    """Longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_equals_the_full_one_within_the_band():
    rng = random.Random(1)
    for _ in range(200):
        t = [rng.randrange(9) for _ in range(rng.randint(3, 15))]
        d = list(t)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(d))
            d[k : k + rng.randint(0, 1)] = [rng.randrange(9) for _ in range(rng.randint(0, 1))]
        m, s, e = align(np.array(t), np.array(d), 0, 20)
        assert m == common_run(t, d)
        if m:
            assert common_run(t, d[s:e]) == m


def test_winnowing_covers_every_window():
    h = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    at = winnow(h, 4)
    for i in range(197):
        inside = at[(at >= i) & (at < i + 4)]
        assert len(inside) and h[inside].min() == h[i : i + 4].min()
    assert len(winnow(grams(h[:1], 2), 4)) == 0


def test_fixture_spans(spark):
    mit = TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "gratis").replace("Software", "Program", 1)
    docs = [
        (1, "Intro. Released under the MIT License. Und é Licensed under CC BY-NC 4.0.\nall RIGHTS reserved"),
        (2, "x " * 500 + mit.upper() + " y" * 500),
        (3, changed),
        (4, "nothing under the sun"),
        (5, None),
        (6, ""),
        (1, "All rights reserved."),
        (7, "Licensed under the Apache License, Version 2.0. " * 3),
        (8, "word " * 200_000 + "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, license string")
    got = scan_licenses(df).collect()
    names = sorted((r.doc_id, r.license) for r in got)
    assert names == [(1, "CC-BY-NC-4.0-line"), (1, "MIT-line"), (1, "Proprietary-line"), (1, "Proprietary-line"), (2, "MIT"), (3, "MIT"), *[(7, "Apache-2.0-line")] * 3, (8, "MIT-line")]
    text = {2: docs[1][1], 8: docs[8][1], 1: docs[0][1]}
    for r in got:
        if r.doc_id == 2:
            assert text[2].encode()[r.start_byte : r.end_byte].decode() == mit.upper().rstrip(".") and r.coverage == 1
        if r.doc_id == 1 and r.license.startswith("CC"):
            assert text[1].encode()[r.start_byte : r.end_byte] == b"Licensed under CC BY-NC 4.0"
        if r.doc_id == 3:
            assert 0.9 < r.coverage < 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_sample_table_equals_brute_force(spark):
    """Every place of every document against every short notice."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = Index(LINES)
    want = set()
    for r in df.collect():
        h = words(np.frombuffer((r.text or "").encode(), np.uint8))[2].tolist()
        for name, t in zip(index.names, (w.tolist() for w in index.words), strict=True):
            near = [i for i in range(len(h)) if h[i] in t]
            for i in near:
                if common_run(t, h[i : i + len(t)]) >= SIMILAR * len(t):
                    want.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in scan_licenses(df, LINES).collect()}
    assert got <= want and len(want - got) == len([w for w in want - got if any(g[0] == w[0] for g in got)])
    assert len(got) > 3


def test_diagonals_in_dense_votes():
    rng = np.random.default_rng(0)
    votes = np.concatenate([rng.integers(0, 5000, 2500), np.full(40, 700), np.full(40, 3000) + rng.integers(0, 4, 40)])
    got = diagonals(votes, 25)
    assert any(abs(d - 700) <= 3 for d in got) and any(abs(d - 3001) <= 4 for d in got) and len(got) <= 4
    assert diagonals(np.array([5, 900]), 1) == [5, 900] and diagonals(np.array([], int), 1) == []


def test_long_text_with_common_words(spark):
    """Words of the template all around don't hide it."""
    rng = random.Random(3)
    noise = " ".join(rng.choices("the of and to in is by software any license copies or without this".split(), k=30_000))
    text = f"{noise} {TEMPLATES['MIT']} {noise}"
    got = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.license, r.coverage) for r in got] == [("MIT", 1.0)]


def names_of(text):
    h = words(np.frombuffer(text.encode(), np.uint8))[2]
    index = Index(TEMPLATES)
    return [(index.names[t], m, s, e) for t, m, s, e in scan(h, index)]


def test_short_templates_close_together_are_all_found():
    assert [n[0] for n in names_of("(c) A Corp. All rights reserved. (c) B Ltd. All rights reserved.")] == ["Proprietary-line"] * 2
    for name, text in LINES.items():
        n = len(words(np.frombuffer(text.encode(), np.uint8))[0])
        for k in (2, 3, 7):
            assert names_of(" ".join([text] * k)) == [(name, n, i * n, (i + 1) * n) for i in range(k)]
            assert [x[0] for x in names_of(" or ".join([text] * k))] == [name] * k


def test_a_block_put_in_or_left_out_of_a_long_notice():
    for name in ("MIT", "Apache-2.0-notice", "BSD-2-Clause"):
        w = TEMPLATES[name].split()
        half = len(w) // 2
        for size in (7, 8, 10):
            header = [f"header{i}" for i in range(size)]
            assert [x[0] for x in names_of(" ".join(w[:half] + header + w[half:]))] == [name]
            got = names_of(" ".join(["before"] * 30 + w[:half] + w[half + size :] + ["after"] * 30))
            assert [x[0] for x in got] == [name] and 30 <= got[0][2] < got[0][3] <= 30 + len(words(np.frombuffer(" ".join(w).encode(), np.uint8))[0])
    assert names_of(" ".join(TEMPLATES["MIT"].split()[:40] + ["header"] * 60 + TEMPLATES["MIT"].split()[40:])) == []


def test_whole_licences_are_told_apart():
    """Each whole text gives its own name, though others share most of its words; so does the part that a notice keeps."""
    whole = [n for n in TEMPLATES if n.endswith(("-full", "-notice"))]
    assert len(whole) >= 10
    for name in whole:
        n = len(words(np.frombuffer(TEMPLATES[name].encode(), np.uint8))[0])
        assert names_of(f"Copyright (c) A Corp. {TEMPLATES[name]}")[-1] == (name, n, 4, 4 + n)
        w = TEMPLATES[name].split()
        assert [x[0] for x in names_of(" ".join([*w[:20], "inserted", *w[20:-1]]))] == [name]
    for part, full in (("MIT", "MIT-full"), ("ISC", "ISC-full"), ("Zlib", "Zlib-full"), ("BSD-2-Clause", "BSD-2-Clause-full")):
        assert [x[0] for x in names_of(TEMPLATES[part])] == [part]
        assert [x[0] for x in names_of(f"{TEMPLATES[full]} and then {TEMPLATES[part]}")] == [full, part]


def test_spans_and_coverage_equal_full_alignment():
    """Against an alignment of the whole text with the whole template, without index, votes or band."""
    rng = random.Random(8)
    for name in ("MIT", "ISC-full", "GPL-notice", "Zlib"):
        for _ in range(4):
            w = TEMPLATES[name].split()
            for _ in range(rng.randint(0, 4)):
                w.insert(rng.randrange(5, len(w) - 5), f"extra{rng.randrange(99)}")
                del w[rng.randrange(5, len(w) - 5)]
            before, after = ([f"{side}{i}" for i in range(rng.randint(3, 40))] for side in ("b", "a"))
            text = words(np.frombuffer(" ".join(before + w + after).encode(), np.uint8))[2]
            template = words(np.frombuffer(TEMPLATES[name].encode(), np.uint8))[2]
            matched, first, end = align(template, text, 0, len(text) + len(template), SIMILAR)
            assert matched == common_run(template.tolist(), text.tolist())
            assert names_of(" ".join(before + w + after)) == [(name, matched, first, end)]
