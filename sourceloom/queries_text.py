"""Text functions over documents, conversations, pages and parts, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import rules
from .functions import text as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 - (CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END) AS line_count FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("line_count"))


@query("""
    WITH l AS (SELECT doc_id, 1 + doc_id % 90 AS f, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents),
    e AS (SELECT doc_id, f, len(x) AS n, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS k FROM l)
    SELECT doc_id, f + k AS line, lpad((f + k)::VARCHAR, length((f + n - 1)::VARCHAR)::INT, ' ') || ' | ' || t AS numbered FROM e""")
def explode_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.explode_lines(docs, F.col("text"), (1 + F.col("doc_id") % 90).cast("int")).select("doc_id", "line", "numbered")


@query("""
    SELECT 'd' || doc_id AS id, regexp_replace(text, '#[^\\n]*', '', 'g') AS code FROM documents
    UNION ALL SELECT 'p' || page_id, regexp_replace(regexp_replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), '/\\*[^*]*\\*/', '', 'g'), '//[^\\n]*', '', 'g') FROM pages""")
def strip_comments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("Python").alias("language"), F.col("text").alias("s"))
    commented = F.replace(F.replace("html", F.lit("<!--"), F.lit("/*")), F.lit("-->"), F.lit("*/"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.lit("C++").alias("language"), commented.alias("s"))
    return docs.unionByName(pages).select("id", T.strip_comments(F.col("s"), F.col("language")).alias("code"))


@query("""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN left(t, 120) || '...' ELSE t END AS short FROM t""")
def shorten_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.shorten(F.col("text")).alias("short"))


@query("""
    WITH t AS (SELECT doc_id, 50 + doc_id % 400 AS m, trim(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM documents),
    h AS (SELECT *, left(t, m) AS h, length(regexp_replace(left(t, m), '\\n[^\\n]*$', '')) AS p, contains(left(t, m), chr(10)) AS has FROM t)
    SELECT doc_id, CASE WHEN length(t) <= m THEN t WHEN has AND p > 0 THEN left(h, p) ELSE h END AS excerpt FROM h""")
def fit_excerpt(spark, sf_dir):
    most = (50 + F.col("doc_id") % 400).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.fit_excerpt(F.col("text"), most).alias("excerpt"))


_SENTENCES = "string_split(regexp_replace(trim(text, E' \\t\\n\\r\\x0b\\f'), '([.!?])[ \\t\\n\\r\\x0b\\f]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS n, {_SENTENCES}[1] AS first_one, array_to_string({_SENTENCES}[1:2], ' ') AS first_two FROM documents")
def sentence_split(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.sentences(t)).cast("long").alias("n"), T.first_sentences(t, 1).alias("first_one"), T.first_sentences(t, 2).alias("first_two"))


_TIDY = """
    WITH a AS (SELECT conv_id, turn, trim(left(text, greatest(0, length(text) - (1 + turn % 4))::INT), E' \\t\\n\\r\\x0b\\f') AS t FROM conversations),
    b AS (SELECT *, length(t) >= 100 AND right(t, 1) NOT IN ('.', '!', '?') AS cut,
                 length(regexp_extract(t, '(?s)^(.*[.!?])(\\s.*)?$', 1)) AS e FROM a),
    c AS (SELECT conv_id, turn, CASE WHEN NOT cut THEN t WHEN e > 0 THEN left(t, e)
                 ELSE rtrim(regexp_replace(t, '(?s) [^ ]*$', ''), ' ,;:(-') || '...' END AS t FROM b),
    d AS (SELECT conv_id, turn, string_split(regexp_replace(t, '([.!?])[ \\t\\n\\r\\x0b\\f]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM c),
    tidy AS (SELECT conv_id, turn, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS tidy FROM d)"""


@query(_TIDY + " SELECT * FROM tidy")
def tidy_answer(spark, sf_dir):
    cut = F.substring("text", F.lit(1), F.greatest(F.lit(0), F.length("text") - (1 + F.col("turn") % 4).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tidy_answer(cut).alias("tidy"))


@query("""
    WITH a AS (SELECT doc_id, left(text, greatest(0, length(text) - (1 + doc_id % 4))::INT) || '...' AS t FROM documents),
    b AS (SELECT doc_id, t, left(t, length(t) - 3) AS body FROM a),
    c AS (SELECT *, regexp_extract(body, '(?s)^(.*)[,;:][^,;:]*$', 1) AS clause FROM b)
    SELECT doc_id, CASE WHEN regexp_matches(body, '[,;:]') AND length(clause) >= 20 THEN rtrim(clause, E' \\t\\n\\r\\x0b\\f') || '.' ELSE t END AS finished FROM c""")
def finish_cut_off(spark, sf_dir):
    cut = F.concat(F.substring("text", F.lit(1), F.greatest(F.lit(0), F.length("text") - (1 + F.col("doc_id") % 4).cast("int"))), F.lit("..."))
    return table(spark, sf_dir, "documents").select("doc_id", T.finish_cut_off(cut).alias("finished"))


@query("""
    WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The function `f` ' WHEN 1 THEN 'method `g` method ' WHEN 2 THEN 'The constructor `h` is ' ELSE '' END AS p, text AS b FROM documents),
    t AS (SELECT doc_id, p || b AS t, regexp_replace(p || b, '(?i)^(the\\s+)?(function|method|constructor|destructor)\\s+`[^`]*`(\\s+(function|method))?\\s*', '') AS r FROM a)
    SELECT doc_id, CASE WHEN length(r) < 20 OR regexp_matches(r, '(?i)^(is|are|was|were|has|have|can|will|does|do)([^A-Za-z0-9_\\x{c0}-\\x{17f}]|$)') THEN t
                        ELSE upper(left(r, 1)) || substr(r, 2) END AS rest FROM t""")
def strip_subject(spark, sf_dir):
    k = F.col("doc_id") % 4
    start = F.when(k == 0, "The function `f` ").when(k == 1, "method `g` method ").when(k == 2, "The constructor `h` is ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_subject(F.concat(start, "text")).alias("rest"))


_RUNS = """
    runs AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS run
             FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i
                   FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents) WHERE len(w) >= 5)),
    items AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS run
             FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i
                   FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark) WHERE len(w) >= 5))"""


@query(f"WITH {_RUNS} SELECT doc_id, item_id, count(*) AS shared FROM runs JOIN items USING (run) GROUP BY ALL")
def copies_instruction(spark, sf_dir):
    from .operators.matching import shared_runs

    return shared_runs(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query(_TIDY.replace("left(text, greatest(0, length(text) - (1 + turn % 4))::INT)", "string_split(trim(text, E' \\t\\n\\r\\x0b\\f'), chr(10))[1]") + """,
    g AS (SELECT conv_id, turn, tidy, CASE WHEN suffix(tidy, '...') THEN left(tidy, length(tidy) - 3) END AS body FROM tidy),
    h AS (SELECT *, regexp_extract(body, '(?s)^(.*)[,;:][^,;:]*$', 1) AS clause FROM g),
    f AS (SELECT conv_id, turn, CASE WHEN body IS NOT NULL AND regexp_matches(body, '[,;:]') AND length(clause) >= 20 THEN rtrim(clause) || '.' ELSE tidy END AS t FROM h),
    s AS (SELECT conv_id, turn, array_to_string(string_split(regexp_replace(trim(t), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS t FROM f),
    w AS (SELECT conv_id, turn, t, regexp_extract_all(lower(t), '[a-z0-9'']+') AS w FROM s),
    cp AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)
          WHERE contains('say what the function of the a is and to the of in', array_to_string(w[i : i + 4], ' ')))
    SELECT conv_id, turn, CASE WHEN length(t) < 20 OR cp.conv_id IS NOT NULL THEN '' ELSE t END AS answer FROM s LEFT JOIN cp USING (conv_id, turn)""")
def clean_answer(spark, sf_dir):
    instruction = F.lit("say what the function of the a is and to the of in")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_answer(F.col("text"), instruction, 2).alias("answer"))


@query("""
    SELECT doc_id, 'File: ' || doc_id || chr(10) || 'Language: ' || lang || chr(10) || 'Type: function' || chr(10) || 'Name: ' || source || chr(10) || chr(10) || text AS chunk
    FROM documents""")
def chunk_text(spark, sf_dir):
    chunk = T.chunk_text(F.col("doc_id").cast("string"), F.col("lang"), F.lit("function"), F.col("source"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", chunk.alias("chunk"))


@query("""
    WITH p AS (SELECT p_brand, array_agg(DISTINCT p_name ORDER BY p_name) AS n FROM part GROUP BY p_brand)
    SELECT p_brand, array_to_string(n[1:8], ', ') || CASE WHEN len(n) > 8 THEN ' and ' || (len(n) - 8) || ' more' ELSE '' END AS listed,
           CASE WHEN len(n[1:3]) <= 1 THEN n[1] ELSE array_to_string(n[1 : least(len(n), 3) - 1], ', ') || ' and ' || n[least(len(n), 3)] END AS joined,
           CASE WHEN len(n) * 7 >= 120 THEN (round_even(len(n) * 7 / 60, 0))::BIGINT || ' minute' ELSE len(n) * 7 || ' second' END AS took
    FROM p""")
def plain_lists(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("n"))
    return names.select(
        "p_brand", T.list_names(F.col("n")).alias("listed"), T.join_clauses(F.slice("n", 1, 3)).alias("joined"),
        T.duration(F.size("n") * 7).alias("took"))


@query("""
    WITH b AS (SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(replace(replace(text, ' de ', ' if '), ' the ', ' for '), '[^A-Za-z0-9_]', '  ', 'g') || ' ', ' (if|for|while|switch|case|catch|except|elif) ')) AS n FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM documents))
    SELECT doc_id, n::BIGINT AS branches, CASE WHEN n >= 20 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END::INT AS points FROM b""")
def branch_points(spark, sf_dir):
    plain = F.regexp_replace("text", "[^ -~]", "x")
    code = F.replace(F.replace(plain, F.lit(" de "), F.lit(" if ")), F.lit(" the "), F.lit(" for "))
    counted = table(spark, sf_dir, "documents").select("doc_id", T.branch_count(code).alias("branches"))
    return counted.withColumn("points", T.branch_points(F.col("branches")))


@query(f"""
    WITH n AS (SELECT p_partkey, lower(p_name || '_' || (['Reader', 'thread', 'unPack', 'parse::it'])[1 + p_partkey % 4]) AS n FROM part)
    SELECT p_partkey, len(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda w: {' OR '.join(f"starts_with(w, '{s}')" for s in rules.OUTSIDE_DATA_STEMS)})) > 0 AS outside FROM n""")
def outside_data_flag(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("Reader", "thread", "unPack", "parse::it"))), (1 + F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.outside_data(F.concat("p_name", F.lit("_"), words)).alias("outside"))


@query("""
    SELECT doc_id, (length(x) - length(replace(x, ' ' || source || '(', ''))) / length(' ' || source || '(') >= 2 AS recurses
    FROM (SELECT doc_id, source, replace(text, ' the ', ' ' || (CASE WHEN doc_id % 2 = 0 THEN source ELSE 'x' || source END) || '(') AS x FROM documents)""")
def recursion_flag(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("x"), "source"))
    code = F.replace("text", F.lit(" the "), F.concat(F.lit(" "), name, F.lit("(")))
    return table(spark, sf_dir, "documents").select("doc_id", T.may_recurse(code, F.col("source")).alias("recurses"))


@query("""
    WITH a AS (SELECT source AS repo, doc_id AS pos, sha256('File: ' || doc_id || chr(10) || text) AS h FROM documents),
    b AS (SELECT repo, pos // 1000 AS p, sha256(string_agg(h, chr(0) ORDER BY pos, h)) AS h FROM a GROUP BY repo, pos // 1000),
    c AS (SELECT repo, p // 1000 AS q, sha256(string_agg(h, chr(0) ORDER BY p)) AS h FROM b GROUP BY repo, p // 1000)
    SELECT repo, sha256(string_agg(h, chr(0) ORDER BY q)) AS digest FROM c GROUP BY repo""")
def snapshot_digest(spark, sf_dir):
    from .sources.snapshots import snapshot_digest as digest

    chunk = F.concat(F.lit("File: "), F.col("doc_id"), F.lit("\n"), F.col("text"))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("pos"), chunk.alias("chunk"))
    return digest(chunks)
