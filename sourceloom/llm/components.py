"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shuffles_released
from .common import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node of links (a, b).

    Alternates the large-star and small-star steps: every node hands its larger, then its smaller
    neighbours to the smallest node that it knows, until all components are stars. Links of a node to
    itself and links with a null end are ignored; repeated links count once; no links give no rows.
    Rounds go on until a round changes nothing, so whole components are returned however long their paths are.
    Nothing is collected: a round is two aggregations and two joins, written to the checkpoint folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct()
    edges = cut_lineage(edges)
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        stars = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        inner = stars.join(least, "u")
        handed = inner.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(handed.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    with shuffles_released(edges.sparkSession):
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
