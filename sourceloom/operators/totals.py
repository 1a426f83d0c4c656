"""Outcome counts per file and in total, and the table of files worth looking at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def review_totals(outcomes: DataFrame, key: str = "path") -> DataFrame:
    """Sums of the counters per file and in total (null key); what was not reached is never negative."""
    counters = ["unit_count", "reviewed", "unflagged", "failed", "with_findings", "finding_count", "unverified"]
    sums = outcomes.rollup(key).agg(*[F.sum(c).cast("long").alias(c) for c in counters], F.sum("model_seconds").alias("model_seconds"))
    return sums.withColumn("not_reached", F.greatest(F.lit(0), F.col("unit_count") - F.col("reviewed") - F.col("failed")))


def documentation_totals(parts: DataFrame, key: str = "path") -> DataFrame:
    """planned, written, unusable, failed, not_written and seconds per file and in total (null key); a part has an outcome and seconds."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    rows = parts.rollup(key).agg(F.count("*").alias("planned"), of("written").alias("written"), of("unusable").alias("unusable"), of("failed").alias("failed"), F.sum("seconds").alias("seconds"))
    return rows.withColumn("not_written", F.greatest(F.lit(0), F.col("planned") - F.col("written") - F.col("unusable") - F.col("failed")))


def stop_reasons(outcomes: DataFrame, group: str) -> DataFrame:
    """Each reason once, with the number of files where it stopped more than one."""
    counted = outcomes.where("stop_reason is not null").groupBy(group, "stop_reason").agg(F.count("*").alias("n"))
    said = F.when(F.col("n") == 1, F.col("stop_reason")).otherwise(F.concat("stop_reason", F.lit(" ("), F.col("n"), F.lit(" files)")))
    return counted.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stop_reason", said.alias("said")))), lambda x: x["said"]), "; ").alias("reasons"))


def review_summary(outcomes: DataFrame, group: str) -> DataFrame:
    """Per group: files found, reviewed (with review units), quiet (without) and skipped (could not be read), and why reviews stopped early.

    outcomes has the group, is_skipped, unit_count and stop_reason of every file. Skipped files give no reason; null counts are
    none; no reasons give an empty text; an empty table gives no rows.
    """
    skipped, units = F.coalesce("is_skipped", F.lit(False)), F.coalesce("unit_count", F.lit(0))
    counts = outcomes.groupBy(group).agg(
        F.count("*").alias("n_files"), F.count_if(~skipped & (units > 0)).alias("n_reviewed"), F.count_if(~skipped & (units == 0)).alias("n_quiet"),
        F.count_if(skipped).alias("n_skipped"))
    reasons = stop_reasons(outcomes.where(~skipped), group)
    return counts.join(reasons, group, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def report_table(totals: DataFrame, group: str, key: str = "path", most: int = 15) -> DataFrame:
    """Per group the first files by findings, then by what was not reached, then by name, and how many more there are."""
    order = Window.partitionBy(group).orderBy(F.desc("finding_count"), F.desc("not_reached"), key)
    # Spark keeps the first rows of each group in every task before it brings a group together
    ranked = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    counted = totals.groupBy(F.col(group).alias("_group")).agg(F.greatest(F.lit(0), F.count("*") - most).alias("n_more"))
    return ranked.join(counted, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
