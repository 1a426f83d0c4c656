"""A partitioned index of vectors: each row lies in the folder of its nearest centre, and a search reads only some of the folders.

Two ways to search: `probed_search` reads as many cells of each query as the wanted recall took in the sample; `indexed_search` is exact,
as it goes on to every cell whose bound says that it may hold something better. On vectors without clusters bounds say little, and the
exact search then reads nearly all cells; `vectors.nearest` does the same without an index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut_lineage
from .vectors import BLOCK, FOUND, best_of_block, first_places

#: The most cells of an index, rows that centres are fitted on, and rows of these that the number of probes is fitted on.
MOST_CELLS, SAMPLE, ASKED = 1024, 20_000, 256


@dataclass(frozen=True)
class Cells:
    """What a search knows of an index: at most MOST_CELLS centres, with the rows and the greatest distance of each cell."""

    number: np.ndarray
    centre: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    probes: int

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Cells (their place in this table) of each query, the best centre first."""
        return np.argsort(-(queries @ self.centre.T), axis=1, kind="stable")

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """No vector x of a cell exceeds this: qx = qc + q(x - c) <= qc + |q| |x - c|."""
        return queries @ self.centre.T + np.linalg.norm(queries, axis=1)[:, None] * self.radius


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    if any(len(v) != size for v in vectors):
        raise ValueError(f"vectors of this index have {size} numbers")
    return np.array(vectors.to_list(), float).reshape(-1, size)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(2 * points @ centres.T - (centres**2).sum(axis=1), axis=1)


def fit_centres(points: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Means of the points nearest to each centre, over some rounds; the first distinct points are the first centres."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:cells]].copy()
    for _ in range(rounds):
        own = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit_probes(points: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells of each point's order that hold the wanted share of its best k others among the points.

    In the whole table the best are nearer than in a sample, so they share a cell more often.
    """
    asked = points[:ASKED]
    scores = asked @ points.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(k, len(points) - 1))]
    own = nearest_centre(points, centres)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build_index(vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, rounds: int = 10) -> None:
    """Write the index of vectors (id, vector) to the new folder path: `rows`, a folder for each cell, and `cells`.

    Centres are fitted on the `sample` rows that come first by hashed id, on the driver; every row is then put into the cell of its
    nearest centre. There are `cells` of these, the square root of the number of rows if it is not given, and never more than MOST_CELLS.
    The tasks that write a cell are as many as its share of the sample asks for. Rows without a vector are not found and so left out;
    vectors of differing sizes are an error; equal vectors share a cell; an empty table gives an index in which nothing is found.
    """
    spark = vectors.sparkSession
    known = vectors.select("id", "vector").where("vector is not null")
    total = known.count()
    first = known.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not total:
        spark.createDataFrame([], "cell int, centre array<double>, n long, radius double, probes int").write.parquet(f"{path}/cells")
        return
    size = len(first["vector"].iloc[0])
    points = _matrix(first["vector"], size)
    centres = fit_centres(points, min(MOST_CELLS, cells or int(np.ceil(np.sqrt(total)))), rounds)
    share = np.bincount(nearest_centre(points, centres), minlength=len(centres)) / len(points)
    pieces = np.maximum(1, np.ceil(share * int(spark.conf.get("spark.sql.shuffle.partitions")))).astype(int)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                own = _matrix(rows["vector"], size)
                cell = nearest_centre(own, centres)
                yield rows.assign(cell=cell, piece=rows["mixed"] % pieces[cell], gap=np.linalg.norm(own - centres[cell], axis=1)).drop(columns="mixed")

    kind = dict(known.dtypes)["vector"]
    placed = known.withColumn("mixed", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInPandas(place, f"id {dict(known.dtypes)['id']}, vector {kind}, cell int, piece int, gap double")
    placed.repartition("cell", "piece").drop("piece").write.partitionBy("cell").parquet(f"{path}/rows")
    probes = fit_probes(points, centres, k, recall)
    found = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    middle = spark.createDataFrame([(c, centre.tolist(), probes) for c, centre in enumerate(centres)], "cell int, centre array<double>, probes int")
    middle.join(found, "cell").select("cell", "centre", "n", "radius", "probes").coalesce(1).write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> Cells | None:
    """The cells that have rows; None for an index of no rows."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    if not len(rows):
        return None
    return Cells(rows["cell"].to_numpy(), np.array(rows["centre"].to_list(), float), rows["n"].to_numpy(), rows["radius"].to_numpy(), int(rows["probes"].iloc[0]))


def _chosen(queries: DataFrame, cells: Cells, choose: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """query_id, query and the list of cells that choose marks for a query (rows: queries, columns: cells)."""
    size = cells.centre.shape[1]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), 512):
                some = rows.iloc[start : start + 512]
                marks = choose(_matrix(some["query"], size), some)
                yield some[["query_id", "query"]].assign(cells=[cells.number[m] for m in marks])

    kind = dict(queries.dtypes)
    return queries.mapInPandas(pick, f"query_id {kind['query_id']}, query {kind['query']}, cells array<int>")


def _best_of_cells(chosen: DataFrame, cells: Cells, path: str, k: int, deals: int) -> DataFrame:
    """The best k of each query in each block of its cells; blocks of a cell and deals of the queries are bounded in size."""
    spark = chosen.sparkSession
    chosen = cut_lineage(chosen)
    wanted = [r.cell for r in chosen.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most MOST_CELLS numbers, for the folders to read
    if not wanted:
        return spark.createDataFrame([], FOUND)
    part = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    sizes = F.broadcast(spark.createDataFrame(list(zip(cells.number.tolist(), (-(-cells.n // BLOCK)).tolist())), "cell int, blocks int"))  # at most MOST_CELLS rows
    q = chosen.select("query_id", "query", F.explode("cells").alias("cell"), part("query_id", F.lit(deals)).alias("deal")).join(sizes, "cell")
    q = q.select("query_id", "query", "cell", "deal", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(wanted)).join(sizes, "cell")
    v = rows.select(F.col("id").alias("key"), F.col("vector").alias("value"), "cell", part("id", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    keys = ["cell", "block", "deal"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(best_of_block(k), FOUND)


def _asked(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries that have a vector, and into how many deals they go."""
    known = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query")).where("query is not null")
    return known, max(1, -(-known.count() // BLOCK))


def _first_cells(cells: Cells, probes: int):
    def choose(queries: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        marks = np.zeros((len(queries), len(cells.number)), bool)
        np.put_along_axis(marks, cells.order(queries)[:, :probes], True, axis=1)
        return marks

    return choose


def probed_search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, id, score and place of the best k in the probed cells of each query (id, vector), about the recall the index was built for.

    Query ids are distinct. Queries without a vector have no rows; ties go to the smaller id; an index of no rows gives none.
    """
    cells = read_cells(queries.sparkSession, path)
    if cells is None:
        return queries.sparkSession.createDataFrame([], FOUND + ", place int")
    asked, deals = _asked(queries)
    return first_places(_best_of_cells(_chosen(asked, cells, _first_cells(cells, probes or cells.probes)), cells, path, k, deals), k)


def indexed_search(queries: DataFrame, path: str, k: int = 10, probes: int = 2, threshold: float | None = None) -> DataFrame:
    """Like probed_search, but exact: the rows of vectors.nearest, of which those below the threshold are left out.

    The first cells give each query its k-th best score; after these only cells whose bound reaches that score (and the threshold) are read.
    """
    cells = read_cells(queries.sparkSession, path)
    if cells is None:
        return queries.sparkSession.createDataFrame([], FOUND + ", place int")
    asked, deals = _asked(queries)
    first = cut_lineage(first_places(_best_of_cells(_chosen(asked, cells, _first_cells(cells, probes)), cells, path, k, deals), k))
    rest = _chosen(asked.join(first.where(F.col("place") == k).select("query_id", "score"), "query_id", "left"), cells, may_hold_better(cells, probes, threshold))
    both = first.drop("place").unionByName(_best_of_cells(rest, cells, path, k, deals))
    found = first_places(both, k)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def may_hold_better(cells: Cells, probes: int, threshold: float | None = None):
    """Marks cells beyond the first ones whose bound reaches the score of a query's row (null: any) and the threshold."""
    first = _first_cells(cells, probes)
    least = -np.inf if threshold is None else threshold

    def choose(queries: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        reached = np.maximum(rows["score"].astype(float).fillna(-np.inf).to_numpy(), least)
        # scores that agree to nine digits are ties
        return (cells.bound(queries) >= reached[:, None] - 1e-8) & ~first(queries, rows)

    return choose
