"""Model answers as data: findings read, checked against the flagged lines, quoted and listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def parse_findings(responses: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, line, problem and fix of each LINE/WHY/FIX triple; of repeated lines the first counts."""
    part = lambda k: F.regexp_extract_all("response", F.lit(rules.FINDING), F.lit(k))
    rows = responses.select(key, F.posexplode(F.arrays_zip(part(1).alias("line"), part(2).alias("why"), part(3).alias("fix"))).alias("k", "f"))
    rows = rows.select(key, "k", F.col("f.line").cast("long").alias("line"), T.tidy_answer(F.col("f.why")).alias("problem"), T.tidy_answer(F.col("f.fix")).alias("fix"))
    first = Window.partitionBy(key, "line").orderBy("k")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "k")


def validate_findings(findings: DataFrame, flagged: DataFrame, key: str = "unit_id", discarded: tuple[str, ...] = rules.DISCARDED_PHRASES) -> DataFrame:
    """Adds code (of the flagged line) and kept: the line was flagged and no discard phrase is in the answer. flagged: key, line, code."""
    lines = flagged.select(key, F.col("line").cast("long").alias("line"), "code").dropDuplicates([key, "line"])
    both = F.lower(F.concat("problem", F.lit(" "), "fix"))
    says_no = F.regexp_like(both, F.lit("|".join(discarded)))
    return findings.join(lines, [key, "line"], "left").withColumn("kept", F.col("code").isNotNull() & ~says_no)


def findings_report(validated: DataFrame, key: str = "unit_id") -> DataFrame:
    """Per key the kept findings as bullets in line order, and how many were thrown away; keys without findings are left out."""
    bullet = F.concat(F.lit("- line "), "line", F.lit(" `"), "code", F.lit("`: "), "problem", F.lit(" Fix: "), "fix")
    rows = validated.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line", bullet.alias("b"))))), lambda x: x["b"]), "\n").alias("report"),
        F.count_if(F.col("kept")).alias("n_kept"), F.count_if(~F.col("kept")).alias("n_thrown_away"))
    return rows.where("n_kept > 0")


def write_report(lines: DataFrame, path: str, lines_per_file: int = 1_000_000) -> None:
    """Write lines (target, place from 0, line) as text, a folder for each target with its lines in the order of place.

    A target has one file, or one for each lines_per_file places, whose folders are in order; so a target of any length is dealt to several
    tasks. Null lines are empty ones; no lines write no files; places of a target should differ.
    """
    part = F.floor(F.col("place") / lines_per_file).cast("int")
    rows = lines.select("target", part.alias("part"), "place", F.coalesce("line", F.lit("")).alias("value"))
    rows = rows.repartition("target", "part").sortWithinPartitions("target", "part", "place")
    rows.drop("place").write.partitionBy("target", "part").text(path)
