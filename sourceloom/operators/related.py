"""Code of the same repository that resembles a chunk, as background for a prompt about it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..scratch import small_batches, stored
from .ranking import numbered

KEYS = ["repo", "path", "pos"]
#: Queries in a block; a task holds them and the best of each.
BLOCK = 32768
#: Queries whose products with some thousand vectors are computed at a time.
TILE = 256
#: The id of a place that is still free.
NOBODY = np.iinfo(np.int64).max


class _Best:
    """The k vectors of greatest inner product of each of some queries, of all vectors that they have met so far.

    Scores are compared rounded to nine places, ties by id. A product in single precision, with a margin for its error, leaves out nearly all pairs; the
    others are computed in double precision, from the first number to the last.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        n, self.k, self.ids, self.met = len(ids), k, ids, 0
        self.columns, self.single = np.ascontiguousarray(queries.T), queries.astype(np.float32)
        self.length = np.sqrt((queries * queries).sum(axis=1))
        self.key, self.score = np.full((n, k), -np.inf), np.full((n, k), np.nan)
        self.id = np.full((n, k), NOBODY)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns, single = np.ascontiguousarray(vectors.T), np.ascontiguousarray(vectors.T.astype(np.float32))
        slack = (len(columns) + 8) * 1.2e-7 * np.sqrt((vectors * vectors).sum(axis=1).max())
        for start in range(0, len(self.ids), TILE):
            stop, at, found, n_found = min(start + TILE, len(self.ids)), 0, [], 0
            least = self.least(start, stop, slack)
            while at < len(ids):
                # the first vectors are met a few at a time, as most of them are among the best so far
                end = min(at + min(max(self.met + at, 2 * self.k, 64), 4096), len(ids))
                hits = np.flatnonzero(~(self.single[start:stop] @ single[:, at:end] < least))  # what is not a number is not left out
                if len(hits):
                    row, column = np.divmod(hits, end - at)
                    found.append((row + start, column + at))
                    n_found += len(hits)
                at = end
                if n_found and (n_found > 1 << 12 or at == len(ids)):
                    self.take(*map(np.concatenate, zip(*found)), ids, columns)
                    found, n_found, least = [], 0, self.least(start, stop, slack)
        self.met += len(ids)

    def least(self, start: int, stop: int, slack: float) -> np.ndarray:
        """What a product must reach in single precision to be looked at."""
        bound = (self.key[start:stop, -1] - 1) / 1e9 - slack * self.length[start:stop]
        return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))[:, None]

    def take(self, row: np.ndarray, column: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        score = np.zeros(len(row))
        for q, v in zip(self.columns, columns):
            score += q[row] * v[column]
        big = score * 1e9
        key = np.where(np.isnan(big), -np.inf, np.copysign(np.floor(np.abs(big) + 0.5), big))
        own, at = np.unique(row, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        keys, scores, all_ids = (np.concatenate([a[own].ravel(), b]) for a, b in ((self.key, key), (self.score, score), (self.id, ids[column])))
        by = np.lexsort((all_ids, -keys, of))
        best = by[np.searchsorted(of[by], np.arange(len(own)))[:, None] + np.arange(self.k)]
        self.key[own], self.score[own], self.id[own] = keys[best], scores[best], all_ids[best]


def _search(group: str, k: int):
    """A function over batches of (group, _q, _v, _held, id, vector), sorted: the queries of a block, then the vectors that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, best = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(best.ids) if best else 0, 8192):
                part = slice(start, start + 8192)
                there = best.id[part] != NOBODY
                asked = np.repeat(best.ids[part], there.sum(axis=1))
                columns = [pa.array([at[0]] * len(asked), pa.string()), *map(pa.array, (asked, best.id[part][there], best.score[part][there], best.key[part][there]))]
                yield pa.RecordBatch.from_arrays(columns, names=[group, "query_id", "id", "score", "_key"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            borders = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)] if marks else []
            for a, b in zip(borders, borders[1:]):
                *key, held = marks[a]
                if key != at:
                    yield from ended()
                    at, waiting, best = key, [], None
                ids = batch.column(4).slice(a, b - a).to_numpy(zero_copy_only=False)
                vectors = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not held:
                    waiting.append((ids, vectors))
                elif waiting or best:
                    best = best or _Best(*map(np.concatenate, zip(*waiting)), k)
                    waiting = []
                    best.meet(ids, vectors)
        yield from ended()

    return run


def nearest_within(queries: DataFrame, vectors: DataFrame, group: str, k: int, block: int = BLOCK) -> DataFrame:
    """group, query_id, id, score and place of the k vectors of a query's own group with the greatest inner product, ties by id.

    Both tables have the group (text), id (unique in its group) and vector (of doubles, all equally long). A group's queries are dealt into blocks, its
    vectors into slices of 16 times as many, both by hashed id. A task holds the queries of a block and the best that they have found, and reads the vectors of a slice
    in batches, so its memory depends on neither table; a small group is one task. All pairs are compared, so the work grows with queries times vectors of a group, and
    what is shuffled with its vectors times its blocks. Scores are compared as rounded to nine places.
    Rows of a null group and queries of groups without vectors find nothing; empty tables give no rows.
    """
    blocks = lambda df, size, name: df.where(F.col(group).isNotNull()).groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(queries, block, "n_q").join(blocks(vectors, 16 * block, "n_v"), group)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vector = F.col("vector").cast("array<double>").alias("vector")
    q = queries.join(sizes, group).select(group, part("n_q").alias("_q"), every("n_v").alias("_v"), F.lit(False).alias("_held"), "id", vector)
    v = vectors.join(sizes, group).select(group, every("n_q").alias("_q"), part("n_v").alias("_v"), F.lit(True).alias("_held"), "id", vector)
    small_batches(queries.sparkSession)
    dealt = q.unionByName(v).repartition(group, "_q", "_v").sortWithinPartitions(group, "_q", "_v", "_held")
    found = dealt.mapInArrow(_search(group, k), f"`{group}` string, query_id long, id long, score double, _key double")
    order = Window.partitionBy(group, "query_id").orderBy(F.desc("_key"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_key")


def related_code(targets: DataFrame, chunks: DataFrame, found: int = 33, threshold: float = 0.4, most: int = 8, longest: int = rules.REVIEW_BUDGET) -> DataFrame:
    """repo, path, pos and related: blocks of code that resemble a target, best first.

    chunks has repo, path, pos, name, symbol_type, start_line, end_line, source and vector; targets has the keys of some of them. Of the
    nearest `found` chunks of its repository those are taken that reach the threshold, are not the target and do not overlap it in its file, at
    most `most`; ties go by path and position. A block names its chunk, and its file where that is another one; blocks longer than `longest`, which
    no prompt could hold, are left out then. Targets without such blocks and rows of a null repository give no row.
    """
    # each step is stored, narrow, so that its shuffle files are gone before the next; nothing here is small enough to be broadcast
    places = stored(numbered(chunks.select(*KEYS, "start_line", "end_line", "vector"), ["repo"], ["path", "pos"], "id"), "places")
    asked = places.join(targets.select(*KEYS).distinct().hint("merge"), KEYS, "left_semi").select("repo", "id", "vector")
    near = nearest_within(asked, places.select("repo", "id", "vector"), "repo", found).where((F.col("score") >= threshold) & (F.col("id") != F.col("query_id")))
    near = stored(near.select("repo", "query_id", "id", "place"), "near")
    lines = places.drop("vector")
    mine = lines.select("repo", F.col("id").alias("query_id"), *[F.col(c).alias("q_" + c) for c in ("path", "pos", "start_line", "end_line")])
    rows = near.join(lines.hint("merge"), ["repo", "id"]).join(mine.hint("merge"), ["repo", "query_id"])
    same_file = F.col("q_path") == F.col("path")
    overlap = same_file & (F.col("q_start_line") <= F.col("end_line")) & (F.col("start_line") <= F.col("q_end_line"))
    order = Window.partitionBy("repo", "query_id").orderBy("place")
    ranked = rows.where(~overlap).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*KEYS, "q_path", "q_pos", "rank")
    ranked = stored(ranked, "ranked")
    # a chunk that very many targets want is a hot key here: its rows are narrow until the join, which splits them where they are too many
    same_file = F.col("q_path") == F.col("path")
    where = F.format_string("%s '%s', lines %d-%d", "symbol_type", "name", "start_line", "end_line")
    where = F.when(same_file, where).otherwise(F.concat(where, F.lit(" of "), F.element_at(F.split("path", "/", -1), -1)))
    block = F.concat(F.lit("["), where, F.lit("]\n"), F.array_join(T.lines_of(F.col("source")), "\n"))
    shown = chunks.where(F.length("source") <= longest).select(*KEYS, "name", "symbol_type", "start_line", "end_line", "source").hint("merge")
    held = ranked.join(shown, KEYS).select("repo", F.col("q_path").alias("path"), F.col("q_pos").alias("pos"), "rank", block.alias("block")).where(F.length("block") <= longest)
    return held.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("related"))
