"""The corpus pipeline: filter by quality, drop near copies, cut repeated strings, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads. All but the
last return the columns of documents.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Scratch, column, table
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.quality import classify
from tidemark.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of near copies, in percent of the shingles of both.
NEAR = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), Scratch(spark)).where("quality_keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id."""
    return near_duplicates(docs, Scratch(spark), percent=NEAR, carry=["lang", "source", "n_chars"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere too; bytes of a character cut apart go with it."""

    def decoded(batches):
        for batch in batches:
            texts = [b.as_py().decode("utf-8", "ignore") for b in column(batch, "kept")]
            cols = {"doc_id": column(batch, "doc_id"), "text": pa.array(texts, pa.string()), "lang": column(batch, "lang"), "source": column(batch, "source"), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], names=COLUMNS)

    left = remove_repeats(docs, Scratch(spark), carry=["lang", "source"]).select("doc_id", "kept", "lang", "source")
    return left.mapInArrow(decoded, "doc_id long, text string, lang string, source string, n_chars long")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target shares of tokens."""
    return mix(docs.select(*COLUMNS), Scratch(spark)).where("mix_kept").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark))


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix_sources),
    ("packing", pack_windows),
]
#: Fitted models, byte-wise repeats and tokenisation have no SQL form; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
