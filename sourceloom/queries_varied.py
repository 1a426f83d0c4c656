"""Extraction over the corpus of plans.varied_view: several repositories, classes, methods, templates and files that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import facts, graph
from .plans.varied_view import VARIED_FACTS, varied_raw
from .scratch import stored
from .sources import extract as X
from .sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"WITH {VARIED_FACTS} {sql}"
        return function

    return add


def _extracted(spark, sf_dir):
    return X.extract(files.read_sources(varied_raw(spark, sf_dir), F.col("repo")))


@query("SELECT repo, path, pos, parent, name, symbol_type, start_line, end_line FROM def")
def varied_chunks(spark, sf_dir):
    return X.chunks_of(_extracted(spark, sf_dir)).select("repo", "path", "pos", "parent", "name", "symbol_type", "start_line", "end_line")


@query("SELECT repo, path, pos, unnest(string_split(calls, ',')) AS called, unnest(range(len(string_split(calls, ','))))::INT AS ord FROM def WHERE calls <> ''")
def varied_calls(spark, sf_dir):
    return X.chunks_of(_extracted(spark, sf_dir)).select("repo", "path", "pos", F.posexplode("called_names").alias("ord", "called"))


@query("SELECT repo, path, pos, is_public FROM def WHERE symbol_type IN ('function', 'method')")
def varied_public(spark, sf_dir):
    """Underscore names are private, methods of C++ unknown; the static function is one of a namespace, so a method too."""
    rows = X.chunks_of(_extracted(spark, sf_dir)).where("symbol_type in ('function', 'method')")
    return rows.select("repo", "path", "pos", facts.is_public(F.col("language"), F.col("symbol_type"), F.col("short_name"), F.col("signature")).alias("is_public"))


@query("SELECT repo, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_rejected FROM file GROUP BY repo")
def varied_rejects(spark, sf_dir):
    good, bad = files.quarantine(_extracted(spark, sf_dir))
    return good.select("repo", F.lit(1).alias("g")).unionByName(bad.select("repo", F.lit(0).alias("g"))).groupBy("repo").agg(F.sum("g").alias("n_good"), (F.count("*") - F.sum("g")).alias("n_rejected"))


@query("""SELECT repo, count(*) AS n_files, sum(CASE WHEN c % 10 = 4 THEN 1 WHEN language = 'Python' THEN 18 ELSE 17 END)::BIGINT AS n_lines, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
    count(*) FILTER (language = 'Python') AS n_entry_points, array_to_string(list_sort(list(DISTINCT CASE WHEN language = 'Python' THEN 'os' ELSE 'map' END)), ',') AS external FROM file WHERE good GROUP BY repo""")
def varied_overview(spark, sf_dir):
    """Every repository has its own counts, entry points and dependencies."""
    extracted = stored(_extracted(spark, sf_dir), "varied")
    chunks = X.chunks_of(extracted)
    resolved = graph.resolve_includes(X.includes_of(extracted), extracted.select("repo", "path"))
    no_effects = extracted.select("repo", "path", F.array().cast("array<string>").alias("effects"))
    return facts.repo_overview(facts.file_facts(extracted, chunks, resolved, no_effects), chunks).withColumn("n_lines", F.col("n_lines").cast("long"))


@query("""SELECT a.repo, a.path, a.pos, b.path AS callee_path, b.pos AS callee_pos, b.name AS callee
    FROM (SELECT *, unnest(string_split(calls, ',')) AS called FROM def) a JOIN def b ON b.repo = a.repo AND b.name = a.called AND b.language = a.language AND b.symbol_type IN ('function', 'method') AND (b.path <> a.path OR b.pos <> a.pos)
    WHERE length(b.name) >= 4 AND (SELECT count(*) FROM def s WHERE s.repo = b.repo AND s.name = b.name AND s.symbol_type IN ('function', 'method')) <= 3""")
def varied_edges(spark, sf_dir):
    """Names that are common in one repository may be trusted in another; edges stay inside a repository."""
    return graph.call_edges(X.chunks_of(stored(_extracted(spark, sf_dir), "varied"))).select("repo", "path", "pos", "callee_path", "callee_pos", "callee")
