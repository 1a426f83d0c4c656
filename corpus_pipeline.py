"""A cleaning and packing pipeline over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourceloom.llm.near_duplicates import drop_similar
from sourceloom.llm.packing import pack_sequences
from sourceloom.llm.quality_rules import drop_low_quality
from sourceloom.llm.toxicity import drop_toxic, fit_toxicity
from sourceloom.scratch import scratch_folder

#: Bytes of a batch of rows on its way to a Python worker. Each running task holds some of them, in the worker and in the executor.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """From here on the session sends batches of bounded bytes to Python workers, unless a bound is set. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts fail them. Columns stay as they are."""
    return drop_low_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a lexicon learned from the labelled ones among them. Columns stay as they are.

    Null and empty texts and texts without matches stay, and so do rows of null ids; equal texts fare alike, whatever their length; an
    empty table gives none.
    """
    _small_batches(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (five words, a similarity of 0.8). Columns stay as they are.

    Candidates come from SimHash segments, links are verified on the whole shingle sets. Null and empty texts are one group; null ids come
    last; of rows equal in id and text one stays; texts of any length count whole; an empty table gives none.
    """
    _small_batches(spark)
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, without their ids.

    Null and empty texts have one piece, a null id stays null, repeated rows are packed each, long texts are cut into pieces; an empty table
    gives none. Other columns are not carried.
    """
    _small_batches(spark)
    return pack_sequences(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Toxicity is learned and near-duplicates are transitive, which SQL cannot express here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each is written, as those that follow read it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
