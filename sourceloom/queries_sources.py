"""Sources, snapshots and ranges over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import answers, ranges
from .queries_text import table
from .scratch import scratch_folder
from .sources import extract as X
from .sources import files, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def discover_files(spark, sf_dir):
    """The files of the tables themselves, by ending."""
    found = files.discover_files(spark, f"{sf_dir}", ("parquet",))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def _raw(spark, sf_dir):
    bad = F.when(F.col("doc_id") % 10 == 0, F.unhex(F.lit("c328"))).otherwise(F.unhex(F.lit("")))
    path = F.concat("source", F.lit("/f"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".cpp"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(F.encode("text", "UTF-8"), bad).alias("raw"))


@query("""SELECT source || '/f' || doc_id || (CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.cpp' END) AS path, CASE WHEN doc_id % 2 = 0 THEN 'Python' ELSE 'C++' END AS language,
    CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS content_md5 FROM documents""")
def read_sources(spark, sf_dir):
    return files.read_sources(_raw(spark, sf_dir)).select("path", "language", F.md5("content").alias("content_md5"))


@query("""SELECT source AS folder, count(*) FILTER (doc_id % 10 <> 0) AS n_good, count(*) FILTER (doc_id % 10 = 0) AS n_rejected FROM documents GROUP BY source""")
def quarantine_files(spark, sf_dir):
    good, bad = files.quarantine(X.extract(files.read_sources(_raw(spark, sf_dir))))
    rows = good.select("path", F.lit(1).alias("g")).unionByName(bad.select("path", F.lit(0).alias("g")))
    return rows.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count_if(F.col("g") == 1).alias("n_good"), F.count_if(F.col("g") == 0).alias("n_rejected"))


@query("""WITH s AS (SELECT DISTINCT text FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 3 = 0 AND doc_id % 2 = 1)
    SELECT doc_id, text IN (SELECT text FROM s) AS reused FROM documents""")
def reuse_embeddings(spark, sf_dir):
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    vector = F.when(F.col("doc_id") % 2 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))  # some are of the wrong size
    saved = docs.where("doc_id % 3 = 0").join(vecs, F.col("vec_id") == F.col("doc_id")).select(
        snapshots.chunk_digest(F.col("text")).alias("text_digest"), vector.alias("vector"), F.col("doc_id").alias("saved_at"))
    known, missing = snapshots.reuse_vectors(docs.select(F.col("doc_id").alias("chunk_id"), "text"), saved, 64)
    rows = known.select("chunk_id", F.lit(True).alias("reused")).unionByName(missing.select("chunk_id", F.lit(False).alias("reused")))
    return rows.select(F.col("chunk_id").alias("doc_id"), "reused")


def _saved(spark, sf_dir):
    """Three snapshots in two saves, and a third save that is killed before it is published."""
    path = scratch_folder(spark, "snapshots")
    of = F.col("label") % 3
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("digest"), of).alias("digest"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), of.cast("long").alias("saved_at"))
    records = rows.select("digest", "chunk_id", F.concat(F.lit("fn_"), "chunk_id").alias("name"))
    # one record of digest2 is missing
    records = records.where((F.col("digest") != "digest2") | (F.col("chunk_id") != rows.where("digest = 'digest2'").agg(F.min("chunk_id")).first()[0]))
    first = F.col("digest") == "digest0"
    snapshots.save_snapshot(rows.where(first), records.where(first), path)
    snapshots.save_snapshot(rows.where(~first), records.where(~first), path)
    snapshots.write_aside(rows.withColumn("saved_at", F.lit(9).cast("long")), records, path)
    return path


@query("""SELECT 'digest' || (label % 3) AS digest, count(*) AS n, count(*) - (label % 3 = 2)::INT AS n_chunks, (label % 3)::BIGINT AS saved_at FROM embeddings GROUP BY label % 3""")
def save_snapshot(spark, sf_dir):
    return snapshots.manifest(spark, _saved(spark, sf_dir)).select("digest", "n", "n_chunks", "saved_at")


@query("SELECT 'digest1' AS digest, vec_id AS chunk_id, 'fn_' || vec_id AS name, len(embedding)::INT AS size FROM embeddings WHERE label % 3 = 1")
def latest_snapshot(spark, sf_dir):
    """The newest published snapshot lacks a chunk record, so the one before it counts; the newest of all was never published."""
    vectors, chunks = snapshots.latest_snapshot(spark, _saved(spark, sf_dir))
    return vectors.join(chunks.select("chunk_id", "name"), "chunk_id").select("digest", "chunk_id", "name", F.size("vector").alias("size"))


@query("""SELECT source AS target, (doc_id // 400)::INT AS part, string_agg('# ' || doc_id || ': ' || n_chars || ' characters' || chr(10), '' ORDER BY doc_id) AS report
    FROM documents GROUP BY ALL""")
def report_sink(spark, sf_dir):
    """The files as they are read back, whole, so that the order of their lines shows."""
    path = scratch_folder(spark, "report")
    line = F.concat(F.lit("# "), "doc_id", F.lit(": "), "n_chars", F.lit(" characters"))
    answers.write_report(table(spark, sf_dir, "documents").select(F.col("source").alias("target"), F.col("doc_id").alias("place"), line.alias("line")), path, 400)
    return spark.read.text(path, wholetext=True).select("target", "part", F.col("value").alias("report"))


@query("""WITH p AS (SELECT p_partkey, (['f', 'A::f', 'a::b::f', 'X::~X'])[1 + p_partkey % 4] || '_' || p_size AS raw FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'b::f_' || p_size WHEN 3 THEN '~X_' || p_size ELSE 'f_' || p_size END AS name,
           CASE p_partkey % 4 WHEN 3 THEN '~X_' || p_size ELSE 'f_' || p_size END AS short_name FROM p JOIN part USING (p_partkey)""")
def chunk_names(spark, sf_dir):
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("f", "A::f", "a::b::f", "X::~X"))), (1 + F.col("p_partkey") % 4).cast("int")), F.lit("_"), "p_size")
    name = T.chunk_name(raw)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), T.short_name(name).alias("short_name"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS start_line, l_partkey % 50 + l_quantity::BIGINT AS end_line FROM lineitem),
    p AS (SELECT a.*, b.start_line AS ps, b.end_line AS pe, row_number() OVER (PARTITION BY a.l_orderkey, a.start_line, a.end_line ORDER BY b.end_line - b.start_line, b.start_line) AS k
          FROM r a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.start_line <= a.start_line AND a.end_line <= b.end_line AND (b.start_line <> a.start_line OR b.end_line <> a.end_line))
    SELECT l_orderkey, start_line, end_line, ps AS parent_start, pe AS parent_end,
           EXISTS (SELECT 1 FROM p q WHERE q.k = 1 AND q.l_orderkey = p.l_orderkey AND q.ps = p.start_line AND q.pe = p.end_line) AS is_container FROM p WHERE k = 1""")
def containment(spark, sf_dir):
    start = F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start_line"), (start + F.col("l_quantity").cast("long")).alias("end_line"))
    return ranges.containment(rows, ["l_orderkey"])
