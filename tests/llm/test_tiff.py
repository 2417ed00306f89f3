import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tiff

RNG = np.random.default_rng(3)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_crosses_every_width_and_a_full_table():
    for data in (RNG.integers(0, 256, 30_000).astype(np.uint8).tobytes(), b"ab" * 20_000, bytes(range(256)) * 60):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    images = [RNG.integers(0, 9, (37, 45), dtype=np.uint8), RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)]
    data = tiff.write(images, compression, predictor, strip=10, tile=tile, order=order)
    back = [s for _, _, s in tiff.pages(data)]
    assert len(back) == 2
    for a, b in zip(images, back, strict=True):
        assert np.array_equal(a.reshape(b.shape), b)


def test_rows_of_pages_and_errors(spark):
    good = tiff.write([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    rows = [(1, good, 0), (2, None, 0), (3, b"", 0), (4, b"junk", 0), (1, good, 0), (5, good[:-60], 0)]
    df = spark.createDataFrame(rows, "id long, media binary, page int")
    got = tiff.tiff_pages(df).collect()
    assert sorted((r.id, r.page) for r in got if r.error is None)[:4] == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r.id for r in got if r.error} == {4, 5}
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_texts_read_back_whole(spark):
    texts = [None, "", "a", "x" * 192, "é" * 97, "word " * 400_000, "a"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in tiff.store_and_read(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
    assert got[2][1:] == got[6][1:] and got[5].n_pages > 1


def test_every_form_reads_back(spark):
    rng = np.random.default_rng(8)
    for k, form in enumerate(tiff.FORMS):
        grid = rng.choice(np.frombuffer(b"etaoin \n\xc3\xa9", np.uint8), (700 + k, tiff.ROW))
        assert np.array_equal(next(tiff.pages(tiff.write([grid], **form)))[2].reshape(grid.shape), grid)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in tiff.store_and_read(docs).collect():
        raw = want[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(raw + b" " * (-len(raw) % 192)).hexdigest()


@pytest.mark.parametrize("tag, value", [(tiff.PREDICTOR, 3), (tiff.FILL_ORDER, 2), (tiff.BITS, 16)])
def test_pages_that_it_cannot_undo_are_errors(tag, value):
    fields = next(tiff.directories(tiff.write([np.zeros((4, 4), np.uint8)])))
    with pytest.raises(ValueError):
        tiff.samples(b"", fields | {tag: (value,)})
