"""Training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradearea.llm import decontam, linedup, minhash, mixing, quality
from tradearea.sources.scratch import cut


#: bytes of a batch on its way to a Python worker; executors hold several batches and workers at a time
BATCH_BYTES = str(4 << 20)


def _bounded(spark: SparkSession) -> None:
    """Batches go by bytes, since documents are of very different length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all columns stay.

    Null, empty and blank texts are texts without words and are judged as such. Equal texts are judged alike, wherever
    they stand; rows that repeat all stay or all go. An empty table stays empty.
    """
    _bounded(spark)
    return quality.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words go; all documents stay, and n_chars follows the text.

    Rows go by id, rows without one first; of runs in rows that share an id the one in the smaller text hash is the first.
    Null texts stay null, a text may become empty. Columns with names of the stage's own stay as they are.
    """
    _bounded(spark)
    return _counted(linedup.without_repeats(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id; one without id only if no other is there.

    Null, empty and blank texts are in no group and stay. Rows that repeat id and text count once. Groups that share
    their smallest id, with different texts, each keep a row.
    """
    _bounded(spark)
    return minhash.one_per_group(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and n_chars follows the text; all documents stay.

    Null texts stay null. Each row is searched whole, by itself: repeats, ids and order play no part. An empty benchmark changes nothing.
    """
    _bounded(spark)
    return _counted(decontam.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns stay, with size, source_size, target, weight and taken: how many words of each document the mix takes.

    A null source is a source, a null text has size 0. Rows that share an id, or have none, are drawn by their text, equal rows one by one.
    """
    _bounded(spark)
    return mixing.mix(docs, carry=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage), ("mixing", mixing_stage)]

#: the classifier's fit and the suffix intervals have no SQL form; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a lost executor costs at most the stage at work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
