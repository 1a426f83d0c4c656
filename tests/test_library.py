"""Sweeps, running sums, pages, split joins, snapshots and reports against brute force."""

import shutil
import tempfile
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom.operators import answers, graph, matching, ranges
from sourceloom.operators.ranking import first_within, paged
from sourceloom.sources import snapshots


@settings(max_examples=300, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).map(lambda t: (t[0], t[0] + t[1])), max_size=25))
def test_sweep_finds_the_smallest_range_around(own):
    around = ranges._Around()
    for start, end in sorted(own, key=lambda r: (r[0], -r[1])):
        best = min(((e - s, s, e) for s, e in own if s <= start and end <= e and (s, e) != (start, end)), default=(None, None, None))
        assert around.find(end) == best[1:]
        around.add(start, end)


def test_a_file_of_very_many_ranges(spark):
    rows = spark.range(100_000).select(F.lit("f").alias("path"), (F.col("id") % 1000).alias("start_line"), (F.col("id") % 1000 + F.floor(F.col("id") / 1000)).alias("end_line"))
    began = time.time()
    found = ranges.containment(rows, ["path"])
    assert found.count() == 100_000 and time.time() - began < 60
    assert found.where("start_line = 5 and end_line = 7").select("parent_start", "parent_end").first() == (4, 7)
    assert ranges.containment(rows.limit(0), ["path"]).count() == 0


@pytest.mark.parametrize("budget", [0, 7, 60, 10_000])
def test_first_within_a_budget(spark, budget):
    rows = [(k % 3 if k % 7 else None, k, k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, n int")
    expected = []
    for g in (None, 0, 1, 2):
        total = 0
        for _, k, n in sorted(r for r in rows if r[0] == g) if g is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total += n
            if total <= budget:
                expected.append((g, k))
    assert sorted(((r.g, r.k) for r in first_within(df, ["g"], ["k"], F.col("n"), budget, 9).collect()), key=str) == sorted(expected, key=str)


def test_pages_hold_every_name(spark):
    edges = spark.createDataFrame([("r", f"u{k:04}", "a" if k % 3 else "b") for k in range(100)] + [("q", "x", "a")], "repo string, path string, dependency string")
    rows = graph.used_by_pages(edges, 7).orderBy("repo", "path", "page").collect()
    assert all(len(r.used_by) <= 7 for r in rows)
    for repo, file in (("r", "a"), ("r", "b"), ("q", "a")):
        pages = [r for r in rows if (r.repo, r.path) == (repo, file)]
        assert [r.page for r in pages] == list(range(len(pages)))
        assert [u for r in pages for u in r.used_by] == sorted(e.path for e in edges.collect() if (e.repo, e.dependency) == (repo, file))
    assert paged(edges.limit(0), ["repo"], "path").count() == 0


def test_split_runs_give_the_same_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hot = docs.withColumn("text", F.concat(F.lit("one two three four five "), "text"))
    asked = hot.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), "text")
    plain = matching.shared_runs(hot, "doc_id", asked, "q", heavy=10**9)
    split = matching.shared_runs(hot, "doc_id", asked, "q", heavy=13)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() >= hot.count() * asked.count()


def test_a_killed_save_changes_nothing(spark):
    path = tempfile.mkdtemp(prefix="snapshots-", dir="/tmp")
    rows = lambda digest, n, at: spark.range(n).select(F.lit(digest).alias("digest"), F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("vector"), F.lit(at).alias("saved_at"))
    chunks = lambda df: df.select("digest", "chunk_id", F.lit("f").alias("name"))
    snapshots.save_snapshot(rows("a", 3, 1), chunks(rows("a", 3, 1)), path)
    newest = lambda: [(df.select("digest").distinct().collect(), df.count()) for df in snapshots.latest_snapshot(spark, path)]
    assert newest() == [([("a",)], 3)] * 2
    folder = snapshots.write_aside(rows("b", 5, 2), chunks(rows("b", 5, 2)), path)  # killed before it is published
    assert newest() == [([("a",)], 3)] * 2
    snapshots.publish(spark, path, folder)
    assert newest() == [([("b",)], 5)] * 2
    snapshots.save_snapshot(rows("c", 4, 3), chunks(rows("c", 3, 3)), path)  # a chunk record is missing
    assert newest() == [([("b",)], 5)] * 2
    assert snapshots.latest_snapshot(spark, path, spark.createDataFrame([("a", 4)], "digest string, n long")) is None
    shutil.rmtree(path)


def test_report_lines_stay_in_order(spark):
    path = tempfile.mkdtemp(prefix="report-", dir="/tmp")
    lines = spark.range(50).select(F.when(F.col("id") < 40, "a").otherwise("b/c").alias("target"), F.col("id").alias("place"), F.when(F.col("id") != 3, F.concat(F.lit("line "), "id")).alias("line"))
    answers.write_report(lines.orderBy(F.desc("id")), f"{path}/out", 30)
    files = spark.read.text(f"{path}/out", wholetext=True).orderBy("target", "part").collect()
    text = lambda a, b: "".join(f"line {k}\n" if k != 3 else "\n" for k in range(a, b))
    assert [(r.target, r.part, r.value) for r in files] == [("a", 0, text(0, 30)), ("a", 1, text(30, 40)), ("b/c", 1, text(40, 50))]
    shutil.rmtree(path)


def test_queries_keep_no_tables(spark, sf_dir, tmp_path):
    """A query sees tables that changed under the same path, whichever query ran before it."""
    from sourceloom import queries

    for name in ("supplier", "part", "lineitem"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    count = lambda: queries.QUERIES["review_prompts"](spark, str(tmp_path)).count()
    before = count()
    spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 20").coalesce(1).write.parquet(str(tmp_path / "few"))
    (tmp_path / "part.parquet").unlink()
    shutil.copytree(tmp_path / "few", tmp_path / "part.parquet")
    spark.catalog.clearCache()
    assert 0 < count() < before
