"""From raw documents to packed training sequences: select by quality, drop shared lines, drop near-duplicates, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.common import table, with_text_batches
from sedge.llm.line_dedup import line_dedup
from sedge.llm.mixing import mix
from sedge.llm.near_dedup import deduplicated
from sedge.llm.packing import pack
from sedge.llm.quality import resampled
from sedge.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    with_text_batches(spark)
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampled(_documents(spark, docs), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(_documents(spark, docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, docs), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs


ORACLE_SQL = None  # models and a tokenizer decide; tests/llm compares with a brute-force version
