"""Source files from folders or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings that are read, case-sensitive.
ENDINGS = ("cpp", "hpp", "h", "py")


def language_of(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".py")), "Python").otherwise("C++")


def discover_files(spark: SparkSession, root: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """path, length and raw content of every source file below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(root)
    return found.select("path", "length", F.col("content").alias("raw"))


def read_sources(files: DataFrame, repo: Column | str = "repo") -> DataFrame:
    """repo, path, content (null where the bytes are not valid UTF-8) and language."""
    repo = F.lit(repo) if isinstance(repo, str) else repo
    return files.select(repo.alias("repo"), "path", F.try_validate_utf8(F.col("raw").cast("string")).alias("content"), language_of(F.col("path")).alias("language"))


def quarantine(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that could be read, and (repo, path, reason) of the others."""
    bad = extracted.where("error is not null").select("repo", "path", F.col("error").alias("reason"))
    return extracted.where("error is null"), bad
