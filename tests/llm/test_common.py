import os

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.common import BATCH_ROWS, Scratch, block_words, by_group, forest, range_hash, raw_texts, text_blocks


class Session:
    """The session, with a setting that a running one doesn't take."""

    def __init__(self, spark, master, folder):
        self.spark, self.conf, self.sparkContext, self.read = spark, self, self, spark.read
        self.given = {}
        self.master, self.folder, self._jvm, self._jsc = master, folder, spark.sparkContext._jvm, spark.sparkContext._jsc

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else self.given.get(key, default)

    def set(self, key, value):
        self.given[key] = value


def test_scratch_writes_where_the_session_says(spark, tmp_path):
    session = Session(spark, "spark://host:1", f"file://{tmp_path}")
    s = Scratch(session)
    assert session.given == {BATCH_ROWS[0]: BATCH_ROWS[1]}
    session.given = {BATCH_ROWS[0]: "77"}  # a session's own setting stays
    assert Scratch(session).base and session.given == {BATCH_ROWS[0]: "77"}
    assert s.keep(spark.range(5), "x").count() == 5
    (own,) = os.listdir(tmp_path)
    s.drop("x")
    assert own.startswith("tidemark-") and "x" not in os.listdir(tmp_path / own)
    s.clear()
    assert own not in os.listdir(tmp_path)


def test_scratch_wants_a_shared_folder_on_a_cluster(spark):
    with pytest.raises(ValueError):
        Scratch(Session(spark, "spark://host:1", None))


def test_equal_ranges_have_equal_hashes():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 2**63, 50).astype(np.uint64)
    twice = np.concatenate([s, s[::-1], s])
    a, b = (range_hash(twice, np.array([k]), np.array([k + 20]))[0] for k in (7, 107))
    assert a == b and a != range_hash(twice, np.array([8]), np.array([28]))[0] and a != range_hash(twice, np.array([7]), np.array([26]))[0]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
def test_texts_of_arrays(kind):
    rows = ["é", None, "", "abc"]
    arr = pa.array([r.encode() if r is not None and kind == pa.binary() else r for r in rows], kind)
    assert [t.tobytes() for t in raw_texts(arr.slice(1))] == [b"", b"", b"abc"]
    assert [(f, d.tobytes(), b.tolist()) for f, d, b in text_blocks(arr, 4)] == [(0, "é".encode(), [0, 2, 2, 2]), (3, b"abc", [0, 3])]
    assert list(text_blocks(arr.slice(0, 0))) == []


def test_words_of_a_block():
    data = np.frombuffer(b"a bba a", np.uint8)
    words, cut = block_words(data, np.array([0, 4, 4, 7]))  # "a bb", "", "a a"
    assert cut.tolist() == [0, 2, 2, 4] and words[0] == words[2] == words[3]


def test_groups_run_across_batches():
    batch = lambda k: pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))})
    got = [g.column("k").to_pylist() for g in by_group(iter([batch([1, 1, 2]), batch([2]), batch([2, 3])]), ["k"])]
    assert got == [[1, 1], [2, 2, 2], [3]]


def test_forest_keeps_components():
    assert forest(np.array([5, 3, 9]), np.array([3, 4, 8])) == {(5, 3), (4, 3), (9, 8)}
