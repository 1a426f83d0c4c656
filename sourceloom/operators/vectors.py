"""Exact nearest neighbours by inner product, in blocks, and a default embedder of built-in functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Vectors in a block; a task holds one block of queries, one of vectors and their products.
BLOCK = 4096
FOUND = "query_id long, id long, score double"


def best_of_block(k: int):
    """A function from a block of queries (query_id, query) and one of vectors (key, value) to the best k of each query."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("key")
        ids, right = b["key"].to_numpy(), np.array(b["value"].to_list(), float)
        out = []
        for start in range(0, len(a), 512):
            some = a.iloc[start : start + 512]
            scores = np.array(some["query"].to_list(), float) @ right.T
            lost, n = np.nan_to_num(-np.round(scores, 12), nan=np.inf), min(k, len(ids))
            # only what reaches the n-th best of its query is sorted, whole ties included
            row, column = np.nonzero(lost <= np.partition(lost, n - 1, axis=1)[:, n - 1 : n])
            by = np.lexsort((column, lost[row, column], row))
            first = np.searchsorted(row, np.arange(len(lost)))
            order = column[by][first[:, None] + np.arange(n)]
            out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), n), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()}))
        return pd.concat(out)

    return best


def first_places(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their place; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, id, score and place of the k vectors with the greatest inner product, ties by id.

    Both tables have id and vector. Queries and vectors are dealt into blocks of bounded size by hashed id; every pair
    of blocks is one small matrix product whose best k per query go on. Nothing is broadcast or collected.
    """
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"), part(n_q).alias("qb"), every(n_v).alias("vb"))
    v = vectors.select(F.col("id").alias("key"), F.col("vector").alias("value"), every(n_q).alias("qb"), part(n_v).alias("vb"))

    local = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best_of_block(k), FOUND)
    return first_places(local, k)


def topk_search(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The best k of each query, of which those below the threshold are then left out."""
    return nearest(queries, vectors, k).where(F.col("score") >= threshold)


def related_chunks(targets: DataFrame, chunks: DataFrame, found: int = 33, threshold: float = 0.4, most: int = 8) -> DataFrame:
    """For each target the first `most` of its nearest `found` chunks that reach the threshold, are not the target
    itself and do not overlap it in its file. Tables have id, vector, path, start_line and end_line."""
    near = nearest(targets.select("id", "vector"), chunks.select("id", "vector"), found).where((F.col("score") >= threshold) & (F.col("id") != F.col("query_id")))
    place = lambda df, key, tag: df.select(F.col("id").alias(key), *[F.col(c).alias(tag + c) for c in ("path", "start_line", "end_line")])
    rows = near.join(place(targets, "query_id", "q_"), "query_id").join(place(chunks, "id", "c_"), "id")
    overlap = (F.col("q_path") == F.col("c_path")) & (F.col("q_start_line") <= F.col("c_end_line")) & (F.col("c_start_line") <= F.col("q_end_line"))
    order = Window.partitionBy("query_id").orderBy("place")
    return rows.where(~overlap).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "id", "score", "rank")


def chat_source(path: Column, first: Column, last: Column, name: Column, score: Column) -> Column:
    return F.format_string("- %s, lines %d-%d: %s (similarity %.2f)", path, first, last, name, score)


def hashed_vector(text: Column, size: int = 16, most: int = 256) -> Column:
    """Counts of the first words by MD5 bucket, as a vector of length one (all zeros without words)."""
    words = F.slice(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), 1, most)
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % size)

    def counts(buckets: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("double"))

    def unit(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(length, lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12))))

    return let(let(buckets, counts), unit)
