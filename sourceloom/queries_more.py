"""Vectors, totals, prompts and answers over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import answers, prompts, signals, totals, vector_index, vectors
from .plans.code_view import FACTS
from .queries_code import KEYS, _HINTS, _scanned, anew
from .queries_text import table
from .scratch import scratch_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = anew(function)
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# Vectors

_NEAR = """ near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, q.label AS q_label, v.label
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS place FROM near)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("path"))
    return rows.withColumn("start_line", F.col("id")).withColumn("end_line", F.col("id") + 3)


@query(f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, place FROM ranked WHERE place <= 5 AND score >= 0.3")
def topk_search(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.topk_search(rows.where("id % 20 = 0"), rows, 5, 0.3).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, place FROM ranked WHERE place <= 5 AND score >= 0.3")
def indexed_search(spark, sf_dir):
    """The rows of topk_search by way of an index: the best cells first, then those whose bound reaches what was found."""
    rows, path = _vectors(spark, sf_dir).select("id", "vector"), scratch_folder(spark, "index")
    vector_index.build_index(rows, path, k=5)
    return vector_index.indexed_search(rows.where("id % 20 = 0"), path, 5, threshold=0.3).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query()
def probed_search(spark, sf_dir):
    """The best five of each query in the cells that the index takes for a recall of 0.97."""
    rows, path = _vectors(spark, sf_dir).select("id", "vector"), scratch_folder(spark, "index")
    vector_index.build_index(rows, path, k=5)
    return vector_index.probed_search(rows.where("id % 20 = 0"), path, 5).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@query(f"""WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM ranked
    WHERE place <= 33 AND score >= 0.4 AND id <> query_id AND NOT (q_label = label AND query_id <= id + 3 AND id <= query_id + 3))
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 8""")
def related_chunks(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.related_chunks(rows.where("id % 20 = 0"), rows).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT a.vec_id AS id, b.vec_id AS other_id FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN -6 AND 6 AND a.vec_id <> b.vec_id
    WHERE NOT (a.label = b.label AND abs(a.vec_id - b.vec_id) <= 3)""")
def overlap_filter(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", "path", "start_line", "end_line")
    steps = F.filter(F.sequence(F.lit(-6), F.lit(6)), lambda k: k != 0)
    near = rows.select("*", F.explode(steps).alias("k")).withColumn("other_id", F.col("id") + F.col("k")).drop("k")
    other = rows.select(*[F.col(c).alias("other_" + c) for c in rows.columns])
    return signals.overlap_filter(near.join(other, "other_id")).select("id", "other_id")


@query(f"""WITH {_NEAR} SELECT query_id, place, '- file' || label || '.py, lines ' || id || '-' || (id + 3) || ': fn_' || id || ' (similarity ' || printf('%.2f', round(score, 2)) || ')' AS source FROM ranked WHERE place <= 3""")
def chat_sources(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    near = vectors.nearest(rows.where("id % 20 = 0"), rows, 3).join(rows.drop("vector"), "id")
    line = vectors.chat_source(F.concat(F.lit("file"), "path", F.lit(".py")), F.col("start_line"), F.col("end_line"), F.concat(F.lit("fn_"), "id"), F.round("score", 2))
    return near.select("query_id", "place", line.alias("source"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:256] AS w FROM documents),
    b AS (SELECT doc_id, ('0x' || left(md5(x), 4))::INT % 16 AS d, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL),
    l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM b GROUP BY doc_id)
    SELECT doc_id, d, round(n / l, 6) AS value FROM b JOIN l USING (doc_id)""")
def embed_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.hashed_vector(F.col("text"))).alias("d", "value"))
    return rows.where("value > 0").select("doc_id", "d", F.round("value", 6).alias("value"))


# Totals

_OUTCOME = """SELECT user_id::VARCHAR AS path, count(*) AS unit_count, count(*) FILTER (event_type IN ('view', 'purchase')) AS reviewed, count(*) FILTER (event_type = 'signup') AS unflagged,
    count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS with_findings, 2 * count(*) FILTER (event_type = 'purchase') AS finding_count,
    count(*) FILTER (event_type = 'click') AS unverified, sum(value) AS model_seconds FROM events GROUP BY user_id"""


def _outcomes(spark, sf_dir):
    is_ = lambda *names: F.count_if(F.col("event_type").isin(*names))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(
        F.count("*").alias("unit_count"), is_("view", "purchase").alias("reviewed"), is_("signup").alias("unflagged"), is_("error").alias("failed"),
        is_("purchase").alias("with_findings"), (2 * is_("purchase")).alias("finding_count"), is_("click").alias("unverified"), F.sum("value").alias("model_seconds"))


_REVIEWED = f"""WITH o AS ({_OUTCOME}), t AS (SELECT path, sum(unit_count)::BIGINT AS unit_count, sum(reviewed)::BIGINT AS reviewed, sum(unflagged)::BIGINT AS unflagged, sum(failed)::BIGINT AS failed,
    sum(with_findings)::BIGINT AS with_findings, sum(finding_count)::BIGINT AS finding_count, sum(unverified)::BIGINT AS unverified, round(sum(model_seconds), 4) AS model_seconds,
    greatest(0, sum(unit_count) - sum(reviewed) - sum(failed))::BIGINT AS not_reached FROM o GROUP BY ROLLUP (path))"""


@query(_REVIEWED + " SELECT * FROM t")
def review_totals(spark, sf_dir):
    return totals.review_totals(_outcomes(spark, sf_dir)).withColumn("model_seconds", F.round("model_seconds", 4))


@query("""WITH o AS (SELECT user_id, user_id % 4 AS repo, user_id % 7 = 0 AS skipped, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) FILTER (event_type = 'purchase') END AS units,
        CASE user_id % 5 WHEN 0 THEN 'out of time' WHEN 1 THEN 'stopped by hand' END AS reason FROM events GROUP BY user_id),
    r AS (SELECT repo, reason || (CASE WHEN count(*) = 1 THEN '' ELSE ' (' || count(*) || ' files)' END) AS said FROM o WHERE NOT skipped AND reason IS NOT NULL GROUP BY repo, reason),
    w AS (SELECT repo, string_agg(said, '; ' ORDER BY said) AS reasons FROM r GROUP BY repo)
    SELECT repo, count(*) AS n_files, count(*) FILTER (NOT skipped AND units > 0) AS n_reviewed, count(*) FILTER (NOT skipped AND units = 0) AS n_quiet, count(*) FILTER (skipped) AS n_skipped,
        coalesce(any_value(reasons), '') AS reasons FROM o LEFT JOIN w USING (repo) GROUP BY repo""")
def review_summary(spark, sf_dir):
    user = F.col("user_id")
    bought = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    outcomes = bought.select(
        (user % 4).alias("repo"), (user % 7 == 0).alias("is_skipped"), F.when(user % 3 == 0, 0).otherwise(F.col("n")).alias("unit_count"),
        F.when(user % 5 == 0, "out of time").when(user % 5 == 1, "stopped by hand").alias("stop_reason"))
    return totals.review_summary(outcomes, "repo")


@query("""SELECT user_id AS path, count(*) AS planned, count(*) FILTER (event_type = 'view') AS written, count(*) FILTER (event_type = 'click') AS unusable, count(*) FILTER (event_type = 'error') AS failed,
    round(sum(value), 4) AS seconds, count(*) FILTER (event_type IN ('signup', 'purchase')) AS not_written FROM events GROUP BY ROLLUP (user_id)""")
def documentation_totals(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "view", "written").when(F.col("event_type") == "click", "unusable").when(F.col("event_type") == "error", "failed")
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), outcome.alias("outcome"), F.col("value").alias("seconds"))
    return totals.documentation_totals(parts).withColumn("seconds", F.round("seconds", 4))


@query(_REVIEWED + """, g AS (SELECT path, path::BIGINT % 4 AS repo, finding_count, not_reached FROM t WHERE path IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY finding_count DESC, not_reached DESC, path)::INT AS place, greatest(0, count(*) OVER (PARTITION BY repo) - 15)::BIGINT AS n_more FROM g)
    SELECT * FROM r WHERE place <= 15""")
def report_table(spark, sf_dir):
    rows = totals.review_totals(_outcomes(spark, sf_dir)).where("path is not null").select("path", (F.col("path").cast("long") % 4).alias("repo"), "finding_count", "not_reached")
    return totals.report_table(rows, "repo").withColumn("n_more", F.col("n_more").cast("long"))


# Prompts

_CHAT = "Answer the question using only the code below."
_NO_CODE = "Answer the question. No code was found for it."


def _excerpt(t: str, m: str) -> str:
    head = f"left({t}, ({m})::INT)"
    return f"""(CASE WHEN length({t}) <= {m} THEN {t} WHEN contains({head}, chr(10)) AND strpos({head}, chr(10)) > 0 AND length({head}) - strpos(reverse({head}), chr(10)) > 0
        THEN left({head}, length({head}) - strpos(reverse({head}), chr(10))) ELSE {head} END)"""


def _fold_chat() -> str:
    steps = []
    for k in (1, 2, 3):
        prior = "SELECT *, '' AS text, 0 AS used, true AS open FROM s" if k == 1 else f"SELECT * FROM f{k - 1}"
        left = f"least(room - length(text) - length(h{k}) - 2, share - length(h{k}) - 2)"
        code = f"CASE WHEN h{k} IS NOT NULL AND open AND {left} > 0 THEN {_excerpt(f't{k}', left)} ELSE '' END"
        steps.append(f"""f{k} AS (SELECT * EXCLUDE (text, used, open, c), CASE WHEN c <> '' THEN text || h{k} || c || chr(10) || chr(10) ELSE text END AS text, used + (c <> '')::INT AS used, open AND c <> '' AS open
            FROM (SELECT *, {code} AS c FROM ({prior})))""")
    return ", ".join(steps)


@query(f"""WITH nd AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id, '[function ''f' || doc_id || ''', lines 1-9 of ' || source || ']' || chr(10) AS h, trim(text, chr(10)) AS t FROM documents),
    q AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS m, 'QUESTION: ' || left(trim(text, E' \\t\\n\\r\\x0b\\f'), 500) || chr(10) AS asked, (conv_id * 7 + turn) % n AS k1, (conv_id * 7 + turn + 1) % n AS k2, (conv_id * 7 + turn + 2) % n AS k3 FROM conversations, nd WHERE role = 'user'),
    j AS (SELECT q.*, a.h AS h1, a.t AS t1, b.h AS h2, b.t AS t2, c.h AS h3, c.t AS t3, 4147 - length('{_CHAT}' || chr(10) || chr(10) || 'CODE:' || chr(10)) - length(asked) - 1 AS room FROM q
          LEFT JOIN d a ON m >= 1 AND a.doc_id = k1 LEFT JOIN d b ON m >= 2 AND b.doc_id = k2 LEFT JOIN d c ON m >= 3 AND c.doc_id = k3),
    s AS (SELECT *, room // greatest(1, m) AS share FROM j), {_fold_chat()}
    SELECT conv_id, turn, used, md5(CASE WHEN m = 0 THEN '{_NO_CODE}' || chr(10) || chr(10) || asked ELSE '{_CHAT}' || chr(10) || chr(10) || 'CODE:' || chr(10) || text || asked END) AS prompt_md5 FROM f3""")
def chat_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    heading = F.concat(F.lit("[function 'f"), "doc_id", F.lit("', lines 1-9 of "), "source", F.lit("]\n"))
    sources = docs.select("doc_id", heading.alias("heading"), F.col("text").alias("source"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").crossJoin(n)
    m = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
    wanted = asked.select("conv_id", "turn", "text", F.posexplode_outer(F.slice(F.array(*[(F.col("conv_id") * 7 + F.col("turn") + k) % F.col("n") for k in range(3)]), F.lit(1), m)).alias("k", "doc_id"))
    joined = wanted.join(sources, "doc_id", "left")
    item = F.when(F.col("heading").isNotNull(), F.struct("k", "heading", "source"))
    rows = joined.groupBy("conv_id", "turn", "text").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    made = rows.select("conv_id", "turn", prompts.chat_prompt(F.col("text"), F.col("chunks"), _CHAT, _NO_CODE).alias("p"))
    return made.select("conv_id", "turn", F.col("p.used").alias("used"), F.md5("p.prompt").alias("prompt_md5"))


@query("""WITH d AS (SELECT doc_id, source, '- ' || doc_id || ': ' || string_split(regexp_replace(trim(text, E' \\t\\n\\r\\x0b\\f'), '([.!?])[ \\t\\n\\r\\x0b\\f]+', '\\1' || chr(1), 'g'), chr(1))[1] || chr(10) AS line FROM documents),
    r AS (SELECT *, sum(length(line)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM d)
    SELECT source, count(*) AS n_files, md5('Say what the project does.' || chr(10) || 'FILES:' || chr(10) || string_agg(line, '' ORDER BY doc_id)) AS prompt_md5 FROM r WHERE upto <= 2700 GROUP BY source""")
def repo_prompts(spark, sf_dir):
    note = F.concat("doc_id", F.lit(": "), T.first_sentences(F.col("text"), 1))
    notes = table(spark, sf_dir, "documents").select("source", "doc_id", note.alias("note"))
    kept = prompts.fit_in_order(notes, "source", "doc_id", "note", 2700)
    text = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "note"))), lambda x: F.concat(F.lit("- "), x["note"], F.lit("\n")))
    return kept.groupBy("source").agg(F.count("*").alias("n_files"), F.md5(F.concat(F.lit("Say what the project does.\nFILES:\n"), F.array_join(text, ""))).alias("prompt_md5"))


@query("""WITH a AS (SELECT doc_id, 'Say what it does.' || chr(10) || 'FUNCTION: f' || doc_id || chr(10) AS start, trim(text, chr(10)) AS t, CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'IT CALLS (do not describe these):' || chr(10) || repeat('- int g(int a)' || chr(10), (doc_id % 3)::INT * 20) END AS bg FROM documents),
    b AS (SELECT *, greatest(1, 2764 - length(start) - 7 - 1) AS room FROM a), """ + f"c AS (SELECT doc_id, bg, start || chr(10) || 'CODE:' || chr(10) || {_excerpt('t', 'room')} || chr(10) AS p FROM b)" + """
    SELECT doc_id, md5(CASE WHEN length(p) + length(bg) <= 2764 THEN p || bg ELSE p END) AS prompt_md5 FROM c""")
def function_prompts(spark, sf_dir):
    start = F.concat(F.lit("Say what it does.\nFUNCTION: f"), "doc_id", F.lit("\n"))
    callees = F.array_repeat(F.lit("int g(int a)"), ((F.col("doc_id") % 3) * 20).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompts.function_prompt(start, F.col("text"), callees)).alias("prompt_md5"))


@query(f"""WITH {FACTS}, b AS (SELECT path, language, count(*) AS n, string_agg('- ' || name || chr(10), '' ORDER BY p) AS all_lines, list(name ORDER BY p) AS names FROM fn GROUP BY path, language),
    s AS (SELECT path, 'FILE: ' || path || ' (' || language || ')' || chr(10) || chr(10) || 'EVERYTHING THE FILE DEFINES (names only):' || chr(10) AS start, names FROM b),
    e AS (SELECT path, start, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM s),
    r AS (SELECT *, length(start) + sum(length(name) + 3) OVER (PARTITION BY path ORDER BY k) <= 300 AS fits FROM e)
    SELECT path, md5(start || coalesce(string_agg('- ' || name || chr(10), '' ORDER BY k) FILTER (fits), '')) AS prompt_md5 FROM r GROUP BY path, start""")
def overview_prompts(spark, sf_dir):
    from .queries_code import _chunks

    rows = _chunks(spark, sf_dir).groupBy("path", "language").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    start = F.concat(F.lit("FILE: "), "path", F.lit(" ("), "language", F.lit(")\n"))
    none = F.array().cast("array<string>")
    return rows.select("path", F.md5(prompts.overview_prompt(start, none, none, F.col("names"), 300)).alias("prompt_md5"))


@query(f"""WITH {FACTS}, pos AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY p) - 1)::INT AS pos FROM fn) {_HINTS},
    l AS (SELECT path, pos, 'line ' || line || ': ' || description AS h FROM hints),
    r AS (SELECT path, pos, h, fn.first, fn.n_lines, fn.name, fn.language, fn.p FROM l JOIN pos fn USING (path, pos))
    SELECT path, pos, length('Review this.' || chr(10) || 'CODE UNDER REVIEW (' || name || ')' || chr(10)) + n_lines * (3 + length((first + n_lines - 1)::VARCHAR)) + n_lines - 1 + src + 1
        + length(chr(10) || 'LINES THAT RULES MATCHED (some may be harmless):' || chr(10)) + length(h) + 1 <= 1500 AS fits
    FROM r JOIN (SELECT p, CASE WHEN language = 'Python' THEN length('def ' || name || '(a, x):') + (['11', '19', '31', '8', '8'])[kind + 1]::INT + (SELECT coalesce(sum(length(c.name) + CASE WHEN c.loop THEN 26 ELSE 7 END), 0) FROM call c WHERE c.caller = p)
                 ELSE length('int ' || name || '(int* a, int x) {{') + 1 + CASE WHEN kind = 0 THEN 17 WHEN kind = 1 THEN 12 WHEN kind = 2 THEN 61 ELSE 10 END + (SELECT coalesce(sum(length(c.name) + CASE WHEN c.loop THEN 53 ELSE 11 END), 0) FROM call c WHERE c.caller = p) END AS src FROM fn) USING (p)""")
def review_prompts(spark, sf_dir):
    scanned = _scanned(spark, sf_dir).where(F.size("hints") > 0)
    lines = T.lines_of(F.col("source"))
    width = F.length((F.col("start_line") + F.size(lines) - 1).cast("string"))
    numbered = F.array_join(F.transform(lines, lambda x, k: F.concat(F.lpad((F.col("start_line") + k).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")
    hints = F.transform("hints", lambda h: F.concat(F.lit("line "), h["line"], F.lit(": "), h["description"]))
    none = F.array().cast("array<string>")
    prompt = prompts.review_prompt(F.lit("Review this."), F.concat(F.lit("CODE UNDER REVIEW ("), "name", F.lit(")")), numbered, hints, none, none, 1500)
    return scanned.select("path", "pos", prompt.isNotNull().alias("fits"))


_BLANKS = "E' \\t\\n\\r\\x0b\\f'"


def _added(k: int) -> str:
    """One step of the related blocks: a block goes in whole, under the heading if it is the first, or not at all."""
    more = f"(CASE WHEN n = 0 THEN chr(10) || 'RELATED CODE (background only, do not review):' || chr(10) ELSE '' END || b[{k}] || chr(10) || chr(10))"
    fits = f"(n < 3 AND length(t) + length({more}) <= 1500)"
    return f"r{k} AS (SELECT doc_id, b, base, CASE WHEN {fits} THEN t || {more} ELSE t END AS t, n + {fits}::INT AS n FROM r{k - 1})"


@query(f"""WITH d AS (SELECT doc_id, 'Review this.' || chr(10) || 'UNIT ' || doc_id || chr(10) || text || chr(10) AS code,
        list_transform(range(1, 1 + doc_id % 4), lambda k: 'line ' || k || ': ' || lang) AS h, list_transform(range(1, 1 + doc_id % 3), lambda k: 'line ' || (k + 9) || ': ' || repeat(source || ' ', 20 * k)) AS c,
        list_transform(range(1, 5), lambda k: k || ' ' || repeat(source || ' ', 1 + (doc_id * k) % 40)) AS b FROM documents),
    f AS (SELECT *, code || CASE WHEN len(h) > 0 THEN chr(10) || 'LINES THAT RULES MATCHED (some may be harmless):' || chr(10) || array_to_string(h, chr(10)) || chr(10) ELSE '' END AS base,
        CASE WHEN len(c) > 0 THEN chr(10) || 'OTHER LINES THAT USE THE SAME NAMES (from elsewhere in the function):' || chr(10) || array_to_string(c, chr(10)) || chr(10) ELSE '' END AS block FROM d),
    r0 AS (SELECT doc_id, b, base, CASE WHEN length(base) + length(block) <= 1500 THEN base || block ELSE base END AS t, 0 AS n FROM f), {", ".join(_added(k) for k in range(1, 5))}
    SELECT doc_id, CASE WHEN length(base) <= 1500 THEN md5(rtrim(t, {_BLANKS}) || chr(10)) END AS prompt_md5, CASE WHEN length(base) <= 1500 THEN n END::INT AS n_related FROM r4""")
def review_prompt_texts(spark, sf_dir):
    """Whole prompts with flagged lines, lines beside them and up to three related blocks."""
    doc = F.col("doc_id")
    items = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), n)), body)).otherwise(F.array().cast("array<string>"))
    many = lambda n: F.repeat(F.concat("source", F.lit(" ")), n.cast("int"))
    hints = items(doc % 4, lambda k: F.concat(F.lit("line "), k, F.lit(": "), F.col("lang")))
    context = items(doc % 3, lambda k: F.concat(F.lit("line "), k + 9, F.lit(": "), many(20 * k)))
    related = items(F.lit(4), lambda k: F.concat(k, F.lit(" "), many(1 + (doc * k) % 40)))
    made = prompts.review_prompt(F.lit("Review this."), F.concat(F.lit("UNIT "), doc), F.col("text"), hints, context, related, 1500)
    rows = table(spark, sf_dir, "documents").withColumn("p", made)
    return rows.select("doc_id", F.md5("p.prompt").alias("prompt_md5"), F.col("p.n_related").alias("n_related"))


def _listed(before: str, items: str, heading: str, budget: str = "100 + doc_id % 200") -> str:
    """SQL of a text with a heading and the lines "- item" up to the first that does not fit."""
    start = f"({before} || chr(10) || '{heading}:' || chr(10))"
    n = f"len(list_filter(range(1, len({items}) + 1), lambda i: length({start}) + list_sum(list_transform({items}[1:i], lambda x: length(x) + 3)) <= {budget}))"
    return f"CASE WHEN len({items}) > 0 THEN {start} || array_to_string(list_transform({items}[1:{n}], lambda x: '- ' || x || chr(10)), '') ELSE {before} END"


@query(f"""WITH d AS (SELECT doc_id, 'FILE: ' || doc_id || chr(10) AS t, string_split(text, ' ')[1 : doc_id % 9] AS a, list_transform(range(1, 1 + doc_id % 3), lambda k: lang || k) AS b,
        list_transform(range(1, 1 + doc_id % 7), lambda k: source || k) AS c FROM documents),
    x AS (SELECT *, {_listed("t", "a", "WHAT ITS MAIN FUNCTIONS DO")} AS t1 FROM d), y AS (SELECT *, {_listed("t1", "b", "TYPES THE FILE DEFINES (names only)")} AS t2 FROM x)
    SELECT doc_id, md5({_listed("t2", "c", "EVERYTHING THE FILE DEFINES (names only)")}) AS prompt_md5 FROM y""")
def overview_prompt_texts(spark, sf_dir):
    """Whole overview prompts with what functions do, types and names, over budgets of several sizes."""
    doc = F.col("doc_id")
    items = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), n)), body)).otherwise(F.array().cast("array<string>"))
    told = F.slice(F.split("text", " ", -1), F.lit(1), (doc % 9).cast("int"))
    text = prompts.overview_prompt(
        F.concat(F.lit("FILE: "), doc, F.lit("\n")), told, items(doc % 3, lambda k: F.concat("lang", k)), items(doc % 7, lambda k: F.concat("source", k)), 100 + doc % 200)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("prompt_md5"))


# Answers

_ANSWERS = f"""WITH {FACTS}, pos AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY p) - 1)::INT AS pos FROM fn) {_HINTS},
    said AS (SELECT path AS unit_id, text AS code, line::BIGINT AS flagged, CASE WHEN line % 4 = 2 THEN line + 1000000 ELSE line END::BIGINT AS line,
        CASE WHEN line % 4 = 1 THEN 'This is a false alarm.' ELSE 'It ' || description || '.' END AS problem, 'Use a safer call (' || line || ').' AS fix FROM hints),
    checked AS (SELECT unit_id, line, problem, fix, CASE WHEN line = flagged THEN code END AS code, line = flagged AND flagged % 4 <> 1 AS kept FROM said)"""


def _responses(spark, sf_dir):
    hints = signals.hint_rows(_scanned(spark, sf_dir), KEYS).withColumn("unit_id", F.col("path"))
    mod = F.col("line") % 4
    number = F.when(mod == 2, F.col("line") + 1000000).otherwise(F.col("line"))
    why = F.when(mod == 1, "This is a false alarm.").otherwise(F.concat(F.lit("It "), "description", F.lit(".")))
    one = F.concat(F.lit("LINE: "), number, F.lit("\nWHY: "), why, F.lit("\nFIX: Use a safer call ("), F.col("line"), F.lit(").\n"))
    again = F.when(mod == 3, F.concat(F.lit("LINE: "), number, F.lit("\n WHY: Once more.\n FIX: Nothing.\n"))).otherwise("")
    order = F.array_sort(F.collect_list(F.struct("line", F.concat(one, again).alias("t"))))
    responses = hints.groupBy("unit_id").agg(F.array_join(F.transform(order, lambda x: x["t"]), "").alias("response"))
    return responses, hints.select("unit_id", "line", F.col("text").alias("code"))


@query(_ANSWERS + " SELECT unit_id, line, problem, fix FROM checked")
def parse_findings(spark, sf_dir):
    responses, _ = _responses(spark, sf_dir)
    return answers.parse_findings(responses).select("unit_id", "line", "problem", "fix")


@query(_ANSWERS + " SELECT unit_id, line, code, kept FROM checked")
def validate_findings(spark, sf_dir):
    responses, flagged = _responses(spark, sf_dir)
    return answers.validate_findings(answers.parse_findings(responses), flagged).select("unit_id", "line", "code", "kept")


@query(_ANSWERS + """ SELECT unit_id, string_agg('- line ' || line || ' `' || code || '`: ' || problem || ' Fix: ' || fix, chr(10) ORDER BY line) FILTER (kept) AS report,
    count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_thrown_away FROM checked GROUP BY unit_id HAVING bool_or(kept)""")
def findings_report(spark, sf_dir):
    responses, flagged = _responses(spark, sf_dir)
    return answers.findings_report(answers.validate_findings(answers.parse_findings(responses), flagged))
