"""Saved embeddings of chunks: keyed by a digest of their texts, reused while these stay the same."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Digests that are joined into one, at each level.
RUN = 1000


def snapshot_digest(chunks: DataFrame, model: str | None = None) -> DataFrame:
    """repo and digest over the model's name and all chunk texts (repo, pos, chunk) in the order of pos.

    A tree of SHA-256: of each text, of runs of 1000 positions, of 1000 such runs, and of these. Digests are joined by NUL,
    texts of one position in the order of their digests. So no row holds more than digests, however large a repository is.
    A null text counts as empty; the digest differs from that of all texts in one string.
    """
    level = chunks.select("repo", F.col("pos").alias("at"), F.sha2(F.coalesce("chunk", F.lit("")), 256).alias("own"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["own"]), "\0")
    rows = F.collect_list(F.struct("at", "own"))
    for _ in range(2):
        level = level.groupBy("repo", F.floor(F.col("at") / RUN).alias("run")).agg(F.sha2(joined(rows), 256).alias("own")).withColumnRenamed("run", "at")
    return level.groupBy("repo").agg(F.sha2(F.concat_ws("\0", F.lit(model), joined(rows)), 256).alias("digest"))


def chunk_digest(text: Column) -> Column:
    """A digest per chunk, so that an unchanged chunk is found in any snapshot."""
    return F.sha2(text, 256)


def write_aside(vectors: DataFrame, chunks: DataFrame, path: str) -> str:
    """Write vectors (digest, chunk_id, vector, saved_at and others) and chunk records (digest, chunk_id and others) to a new folder below
    path, each parted by digest. Nobody reads the folder before publish names it."""
    folder = f"data-{uuid.uuid4().hex}"
    vectors.write.partitionBy("digest").parquet(f"{path}/{folder}/vectors")
    chunks.write.partitionBy("digest").parquet(f"{path}/{folder}/chunks")
    return folder


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Add a folder's snapshots to the manifest: digest, saved_at, n (its vectors), n_chunks and folder, in one small file.

    The file appears whole or not at all, when Spark commits it; a folder that was never published is as if it had not been written.
    """
    vectors = spark.read.parquet(f"{path}/{folder}/vectors").groupBy("digest").agg(F.max("saved_at").alias("saved_at"), F.count("*").alias("n"))
    chunks = spark.read.parquet(f"{path}/{folder}/chunks").groupBy("digest").agg(F.count("*").alias("n_chunks"))
    rows = vectors.join(chunks, "digest", "left").select(F.col("digest").cast("string").alias("digest"), "saved_at", "n", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(folder).alias("folder"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def save_snapshot(vectors: DataFrame, chunks: DataFrame, path: str) -> None:
    """Write vectors and chunk records aside, then publish them. A save that is killed leaves the snapshots before it as they were."""
    publish(vectors.sparkSession, path, write_aside(vectors, chunks, path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All published snapshots; of those of one digest all are listed, the newest counts."""
    return spark.read.parquet(f"{path}/manifest")


def latest_snapshot(spark: SparkSession, path: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Vectors and chunk records of the newest snapshot with as many of the one as of the other; with expected (digest, n), of the newest that has n
    vectors. None if there is none.

    Only the manifest is read to find it, and then only the folders of its digest.
    """
    heads = manifest(spark, path).where("n = n_chunks")
    if expected is not None:
        heads = heads.join(expected, ["digest", "n"], "left_semi")
    newest = heads.orderBy(F.desc("saved_at"), F.desc("digest"), F.desc("folder")).first()
    if newest is None:
        return None
    kinds = (spark.read.parquet(f"{path}/{newest.folder}/{kind}") for kind in ("vectors", "chunks"))
    vectors, chunks = (df.where(F.col("digest") == newest.digest) for df in kinds)
    return vectors, chunks


def reuse_vectors(chunks: DataFrame, saved: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, text) with a saved vector of the right size, and those that have to be embedded.

    saved has text_digest and vector; of several vectors of a text the first by saved_at counts.
    """
    keyed = chunks.withColumn("text_digest", chunk_digest(F.col("text")))
    order = Window.partitionBy("text_digest").orderBy("saved_at", F.to_json(F.struct("vector")))
    usable = saved.where(F.size("vector") == size).withColumn("_k", F.row_number().over(order)).where("_k = 1").select("text_digest", "vector")
    return keyed.join(usable, "text_digest"), keyed.join(usable, "text_digest", "left_anti")
