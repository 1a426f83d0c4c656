"""Numbers, running sums and pages of rows within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut_lineage


def numbered(rows: DataFrame, groups: list[str], order: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the place (from 1) of each row in its group by the given order, which should leave no ties.

    Rows are dealt into ranges of group and order; a row's place is its place in the range, plus what the group has in the
    ranges before. So a group of any size is spread over tasks, and only a count per group and range is brought together.
    The ranged rows are written, as ranges may differ when they are found anew. Null groups are a group; an empty table
    gives no rows; columns of rows must not be named _range, _before or _rows.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*groups, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    found = ranged.withColumn(name, inside).alias("r").join(counts.alias("c"), [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*groups, "_range")])
    return found.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r." + name) + F.col("_before")).cast("long").alias(name))


def first_within(rows: DataFrame, groups: list[str], order: list[Column | str], size: Column, budget: int, parts: int | None = None) -> DataFrame:
    """The first rows of each group, in the given order, whose running sum of size is at most budget.

    Rows are dealt into ranges of group and order; sizes are summed by range, and of the ranges only those are summed row by row that begin within
    the budget. The order should leave no ties; null groups are a group; an empty table gives no rows; sizes must not be negative; columns of
    rows must not be named _range, _before or _size.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.withColumn("_size", size.cast("long")).repartitionByRange(parts, *groups, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*groups, "_range").agg(F.sum("_size").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*groups, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    near = ranged.alias("r").join(begun.alias("c"), [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*groups, "_range")]).select("r.*", "c._before")
    upto = Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("_size", F.sum("_size").over(upto) + F.col("_before")).where(F.col("_size") <= budget).drop("_range", "_size", "_before")


def paged(rows: DataFrame, groups: list[str], name: str, size: int = 1000) -> DataFrame:
    """The whole sorted list of each group's names in pages: groups, page (from 0) and the column of names, an array of at most size.

    Equal names of a group should have been made one; no names give no page.
    """
    placed = numbered(rows.select(*groups, name), groups, [name], "_place").withColumn("page", F.floor((F.col("_place") - 1) / size).cast("int"))
    return placed.groupBy(*groups, "page").agg(F.sort_array(F.collect_list(name)).alias(name))
