"""Queries over the corpus tables, one per operator, with production parameters.

ORACLE_SQL states op1, op3, op4 and op10; tests/llm holds the others against plain versions, round
trips, statistics or held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, table
from .oracle import ORACLE_SQL


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark)).drop("kept")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_seen

    return remove_seen(table(spark, sf_dir, "documents"), Scratch(spark)).drop("kept")


def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark), columns=["doc_id"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), Scratch(spark), columns=["doc_id", "source", "lang"])


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark)).drop("original", "uid")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_licenses": op2_licenses,
    "op3_substrings": op3_substrings,
    "op4_itq": op4_itq,
    "op5_tiff": op5_tiff,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_html": op9_html,
    "op10_minhash": op10_minhash,
}
