"""The partitioned vector index against exact search."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sourceloom.operators import vector_index as V
from sourceloom.operators.vectors import nearest


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + k, row.tolist()) for k, row in enumerate(matrix)], "id long, vector array<double>")


def clustered(n, clusters, size=16, seed=1):
    made = np.random.default_rng(seed)
    middle = made.normal(size=(clusters, size)) * 4
    return middle[made.integers(clusters, size=n)] + made.normal(size=(n, size)) * 0.2


def places(df):
    return sorted((r.query_id, r.place, r.id, round(r.score, 6)) for r in df.collect())


def built(spark, rows, **how):
    path = tempfile.mkdtemp(prefix="index-", dir="/tmp") + "/i"
    V.build_index(rows, path, **how)
    return path


def test_exact_search_equals_all_pairs(spark):
    matrix = clustered(700, 9)
    matrix[:250] = matrix[0]  # a third of all rows are one vector
    rows = frame(spark, matrix)
    asked = rows.where("id % 20 = 0")
    path = built(spark, rows, cells=20)
    assert spark.read.parquet(f"{path}/rows").count() == 700
    assert places(V.indexed_search(asked, path, 7, probes=1)) == places(nearest(asked, rows, 7))
    over = V.indexed_search(asked, path, 7, probes=1, threshold=260.0)
    assert places(over) == places(nearest(asked, rows, 7).where("score >= 260.0"))


def test_small_blocks_and_deals(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rows = frame(spark, clustered(300, 3))
    path = built(spark, rows, cells=4)
    assert places(V.indexed_search(rows, path, 4)) == places(nearest(rows, rows, 4))


def test_bounds_leave_cells_out():
    """On clustered unit vectors most cells cannot hold anything better, and no row beyond its cell's bound exists."""
    points = clustered(2000, 30)
    points /= np.linalg.norm(points, axis=1)[:, None]
    centres = V.fit_centres(points, 60, 10)
    own = V.nearest_centre(points, centres)
    gap = np.linalg.norm(points - centres[own], axis=1)
    used = np.unique(own)
    cells = V.Cells(used, centres[used], np.bincount(own)[used], np.array([gap[own == c].max() for c in used]), 1)
    asked = points[::20]
    scores = asked @ points.T
    bound = cells.bound(asked)
    assert all((scores[:, own == c].max(axis=1) <= bound[:, j] + 1e-9).all() for j, c in enumerate(used))
    fifth = pd.DataFrame({"score": np.sort(scores, axis=1)[:, -5]})
    assert V.may_hold_better(cells, 1)(asked, fifth).mean() < 0.2
    assert V.may_hold_better(cells, 1)(asked, pd.DataFrame({"score": [None] * len(asked)})).mean() > 0.9


@pytest.mark.parametrize("kind", ["given", "clustered"])
def test_recall_of_probed_search(spark, kind):
    """At least 0.95 of the true best five, from fewer rows than there are."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    if kind == "clustered":
        rows = frame(spark, clustered(2000, 30))
    path = built(spark, rows, k=5)
    asked = rows.where("id % 20 = 0")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    true = pairs(nearest(asked, rows, 5))
    assert len(true & pairs(V.probed_search(asked, path, 5))) >= 0.95 * len(true)
    cells = V.read_cells(spark, path)
    queries = np.array([r.vector for r in asked.collect()], float)
    work = (V._first_cells(cells, cells.probes)(queries, None) @ cells.n).mean() / cells.n.sum()
    assert work < (1 if kind == "given" else 0.2)  # the given vectors have hardly any clusters: 0.78 of the rows


def test_rows_without_vectors_and_empty_tables(spark):
    rows = frame(spark, clustered(30, 2)).unionByName(spark.createDataFrame([(99, None)], "id long, vector array<double>")).withColumn("cell", F.lit("x"))
    path = built(spark, rows)
    found = V.indexed_search(rows, path, 40)
    assert found.count() == 900 and found.where("id = 99 or query_id = 99").count() == 0
    assert V.indexed_search(rows.limit(0), path, 3).count() == 0 and V.probed_search(rows.limit(0), path, 3).count() == 0
    empty = built(spark, rows.limit(0))
    assert V.indexed_search(rows, empty, 3).count() == 0 and V.probed_search(rows, empty, 3).count() == 0
    with pytest.raises(Exception, match="have 16 numbers"):
        V.build_index(rows.unionByName(spark.createDataFrame([(100, [1.0], "y")], "id long, vector array<double>, cell string")), path + "2")
