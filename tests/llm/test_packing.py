import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.common import Scratch
from tidemark.llm.packing import CapacityTree, Encoder, best_fit_plan, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "one word", "  two   spaces \n\n line", "the cat sat. " * 700, "<|endoftext|> don't", "a" * 5000, "the cat sat. " * 700, "a <|endoftext|> b", "é ü 漢字  x"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*" ab\n\t'.1é <|>", "<|endoftext|>", "endoftext"]), max_size=40).map("".join))
def test_ids_equal_those_of_the_vocabulary_file(text):
    t = Tokenizer.from_file(PATH) if not hasattr(test_ids_equal_those_of_the_vocabulary_file, "t") else test_ids_equal_those_of_the_vocabulary_file.t
    test_ids_equal_those_of_the_vocabulary_file.t = t
    e = getattr(test_ids_equal_those_of_the_vocabulary_file, "e", None) or Encoder(PATH)
    test_ids_equal_those_of_the_vocabulary_file.e = e
    assert np.frombuffer(e(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 20), max_size=20), st.integers(0, 20))
def test_tree_finds_the_tightest_capacity(capacities, least):
    tree = CapacityTree(21)
    for c in capacities:
        tree.add(c, 1)
    assert tree.tightest(least) == min((c for c in capacities if c >= least), default=-1)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=8))
def test_plan_is_best_fit_decreasing(histogram):
    plan = best_fit_plan(histogram, 32)
    used, placed = {}, {}
    for length, rank, n, first, offset in plan:
        for i in range(n):
            assert used.get(first + i, 0) == offset
            used[first + i] = offset + length
            placed.setdefault(length, set()).add(rank + i)
    assert placed == {k: set(range(n)) for k, n in histogram.items()}
    free = []  # plain best fit opens as many windows
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((f for f in free if f >= length), default=None)
        if fit is None:
            free.append(32 - length)
        else:
            free[free.index(fit)] -= length
    assert sorted(free) == sorted(32 - u for u in used.values())
    assert all(u <= 32 for u in used.values())


def test_pieces_cover_every_id(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "x")], "doc_id long, text string, start string")
    rows = pack(docs, PATH, Scratch(spark)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for doc, pieces in by_doc.items():
        ids = np.array(reference(TEXTS[doc]) + [0], "<u4")
        copies = 2 if doc == 7 else 1
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert sorted(sequences) == list(range(len(sequences)))


def test_the_added_token_and_null_ids(spark):
    assert np.frombuffer(Encoder(PATH)("<|endoftext|>"), "<u4").tolist() == [50256]
    rows = pack(spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string"), PATH, Scratch(spark)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 3), (1, 3)]


def test_an_empty_table_gives_no_rows(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, Scratch(spark)).count() == 0
