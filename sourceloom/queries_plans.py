"""Whole jobs over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import facts, graph, related, signals, vectors
from .plans import review
from .plans.code_view import FACTS
from .queries_code import _CONTEXT, _EDGES, _HINTS, _chunks, _facts, _scanned, _scored, anew
from .queries_code import ORACLES as _KNOWN

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_POS = f"WITH {FACTS}, pos AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY p) - 1)::INT AS pos FROM fn)"

_UNITS = f"""{_POS} {_HINTS}, {_CONTEXT.replace(', b AS', 'b AS', 1).replace(chr(10) + '    SELECT path, pos, (CASE', ', ctx AS (SELECT path, pos, (CASE', 1)}),
    hot AS (SELECT DISTINCT b.path, b.pos FROM call c JOIN share USING (name) JOIN pos b ON b.name = c.name AND b.p <> c.caller WHERE n_same <= 3 AND c.loop),
    src AS (SELECT p, path, pos, first, n_lines, n_lines - 1 + CASE WHEN language = 'Python' THEN length(name) + 11 + ([11, 19, 31, 8, 8])[kind + 1] + (SELECT coalesce(sum(length(c.name) + CASE WHEN c.loop THEN 26 ELSE 7 END), 0) FROM call c WHERE c.caller = p)
        ELSE length(name) + 21 + CASE WHEN kind = 0 THEN 17 WHEN kind = 1 THEN 12 WHEN kind = 2 THEN 58 + 17 * even::INT ELSE 10 END + (SELECT coalesce(sum(length(c.name) + CASE WHEN c.loop THEN 53 ELSE 11 END), 0) FROM call c WHERE c.caller = p) END AS size FROM pos),
    unit AS (SELECT h.path, h.pos, h.kind, CASE WHEN size <= 1500 THEN first ELSE greatest(first, line - 12) END::INT AS first, CASE WHEN size <= 1500 THEN first + n_lines - 1 ELSE least(first + n_lines - 1, line + 12) END::INT AS last,
        (h.points + CASE WHEN h.kind = 'SECURITY' THEN ctx.points ELSE 2 * (hot.path IS NOT NULL)::INT END)::INT AS score
        FROM hints h JOIN src USING (path, pos) JOIN ctx USING (path, pos) LEFT JOIN hot ON hot.path = h.path AND hot.pos = h.pos)
    SELECT *, row_number() OVER (ORDER BY score DESC, path, pos, first, kind)::INT AS place FROM unit"""


def _plan(spark, sf_dir):
    scanned = _scanned(spark, sf_dir)
    return review.review_plan(scanned, graph.hot_callees(signals.loop_calls(scanned), _chunks(spark, sf_dir)))


def review_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].select("path", "pos", "kind", "first", "last", "score", "place")


def _related(spark, sf_dir):
    """Of every chunk with a hint, from the vectors of all chunks."""
    text = T.chunk_text(F.col("path"), F.col("language"), F.col("symbol_type"), F.col("name"), F.col("source"))
    chunks = _chunks(spark, sf_dir).withColumn("vector", vectors.hashed_vector(text))
    return related.related_code(_scanned(spark, sf_dir).where(F.size("hints") > 0), chunks)


def related_code(spark, sf_dir):
    return _related(spark, sf_dir).select("path", "pos", F.posexplode("related").alias("place", "block")).select("path", "pos", "place", F.md5("block").alias("block_md5"))


def planned_prompts(spark, sf_dir):
    """Whole prompts of the plan, with related code."""
    made = review.plan_prompts(_plan(spark, sf_dir)[0], _chunks(spark, sf_dir), _related(spark, sf_dir))
    return made.select("path", "pos", "kind", "first", "place", "n_related", F.md5("prompt").alias("prompt_md5"))


def context_lines(spark, sf_dir):
    """Lines beside a narrow window (the flagged line alone) of every chunk with a hint."""
    rows = _scanned(spark, sf_dir).where(F.size("hints") > 0)
    line = F.element_at("hints", 1)["line"]
    found = review.context_lines(F.split("code", "\n", -1), T.lines_of(F.col("source")), F.col("start_line"), line, line, F.array(line), F.col("language"))
    return rows.select("path", "pos", F.inline(found))


def file_document(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    important = facts.important_functions(_scored(spark, sf_dir))
    callees = graph.callees_of(graph.call_edges(chunks)).select("repo", "path", "pos", "names")
    return review.file_document(_facts(spark, sf_dir), important, callees, facts.listed_symbols(chunks)).select("path", "report")


QUERIES |= {"review_plan": anew(review_plan), "related_code": anew(related_code), "planned_prompts": anew(planned_prompts), "context_lines": anew(context_lines), "file_document": anew(file_document)}
ORACLES["review_plan"] = _UNITS
# Sources of all functions, their vectors, and the blocks of code that resemble each function with a hint.
_LOOP = "'    for (int i = 0; i < x; i++) {' || chr(10)"
_RELATED = f"""body AS (SELECT caller AS p, string_agg(CASE WHEN language = 'Python' THEN CASE WHEN loop THEN '    for i in a:' || chr(10) || '        ' || name || '(i)' ELSE '    ' || name || '(x)' END
            WHEN loop THEN {_LOOP} || '        ' || name || '(a, i);' || chr(10) || '    }}' ELSE '    ' || name || '(a, x);' END, chr(10) ORDER BY callee) AS calls FROM call GROUP BY caller),
    code AS (SELECT pos.*, CASE WHEN language = 'Python' THEN 'def ' || name || '(a, x):' || chr(10)
            || CASE kind WHEN 0 THEN '    eval(x)' WHEN 1 THEN '    pickle.loads(x)' WHEN 2 THEN '    for i in a:' || chr(10) || '        open(x)' ELSE '    pass' END || coalesce(chr(10) || calls, '')
        ELSE 'int ' || name || '(int* a, int x) {{' || chr(10) || CASE kind WHEN 0 THEN '    strcpy(a, b);' WHEN 1 THEN '    atoi(a);'
            WHEN 2 THEN CASE WHEN even THEN '    a.reserve(x);' || chr(10) ELSE '' END || {_LOOP} || '        a.push_back(i);' || chr(10) || '    }}' ELSE '    x = 1;' END
            || coalesce(chr(10) || calls, '') || chr(10) || '}}' END AS source FROM pos LEFT JOIN body USING (p)),
    word AS (SELECT p, unnest(list_filter(regexp_split_to_array(lower('File: ' || path || chr(10) || 'Language: ' || language || chr(10) || 'Type: function' || chr(10) || 'Name: ' || name || chr(10) || chr(10) || source),
        '[^a-z0-9]+'), lambda x: x <> '')[1:256]) AS w FROM code),
    bucket AS (SELECT p, ('0x' || left(md5(w), 4))::INT % 16 AS d, count(*) AS n FROM word GROUP BY ALL),
    vec AS (SELECT p, list_transform(range(16), lambda d: coalesce(map_extract(m, d)[1], 0) / l) AS v FROM (SELECT p, map(list(d::BIGINT), list(n::DOUBLE)) AS m, sqrt(sum(n * n)) AS l FROM bucket GROUP BY p)),
    item AS (SELECT p, v, path, pos, name, first, first + n_lines - 1 AS last, source, row_number() OVER (ORDER BY path, pos) AS id FROM code JOIN vec USING (p)),
    asked AS (SELECT item.* FROM item JOIN (SELECT DISTINCT path, pos FROM hints) USING (path, pos)),
    near AS (SELECT q.p, q.path = c.path AS own, q.path = c.path AND q.first <= c.last AND c.first <= q.last AS overlap, q.id = c.id AS self, c.id, list_inner_product(q.v, c.v) AS score FROM asked q, item c),
    best AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(score, 9) DESC, id) AS k FROM near),
    eight AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k) AS r FROM best WHERE k <= 33 AND score >= 0.4 AND NOT self AND NOT overlap),
    block AS (SELECT e.p, r, '[function ''' || name || ''', lines ' || first || '-' || last || CASE WHEN own THEN '' ELSE ' of ' || regexp_extract(path, '[^/]+$') END || ']' || chr(10) || source AS block
        FROM eight e JOIN item USING (id) WHERE r <= 8),
    kept AS (SELECT p, block, (row_number() OVER (PARTITION BY p ORDER BY r) - 1)::INT AS place FROM block WHERE length(block) <= 2764)"""
ORACLES["related_code"] = f"""{_POS} {_HINTS}, {_RELATED} SELECT path, pos, place, md5(block) AS block_md5 FROM kept JOIN pos USING (p)"""


def _with_block(k: int) -> str:
    """One step of the related blocks: a block goes in whole, under the heading if it is the first, or not at all."""
    more = f"(CASE WHEN n = 0 THEN chr(10) || 'RELATED CODE (background only, do not review):' || chr(10) ELSE '' END || b[{k}] || chr(10) || chr(10))"
    fits = f"coalesce(n < 3 AND length(t) + length({more}) <= 2764, false)"
    return f"r{k} AS (SELECT path, pos, kind, first, place, b, CASE WHEN {fits} THEN t || {more} ELSE t END AS t, n + {fits}::INT AS n FROM r{k - 1})"


# A flagged line uses x (or a and b, a and i): the definition names them, loop headers give i a value.
ORACLES["context_lines"] = f"""{_POS} {_HINTS}, f AS (SELECT h.path, h.pos, h.line, pos.first, pos.n_lines, pos.p, pos.language, pos.kind, pos.even, pos.name FROM hints h JOIN pos USING (path, pos)),
    cand AS (SELECT path, pos, first AS place, line, CASE WHEN language = 'Python' THEN 'def ' || name || '(a, x):' ELSE 'int ' || name || '(int* a, int x) {{' END AS text FROM f
        UNION ALL SELECT path, pos, first + 1, line, CASE WHEN language = 'Python' THEN NULL ELSE 'for (int i = 0; i < x; i++) {{' END FROM f WHERE kind = 2 AND language = 'C++'
        UNION ALL SELECT f.path, f.pos, c.line - 1, f.line, 'for (int i = 0; i < x; i++) {{' FROM f JOIN call c ON c.caller = f.p AND c.loop WHERE f.language = 'C++' AND f.kind = 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY path, pos ORDER BY abs(place - line), place) AS k FROM cand)
    SELECT path, pos, place::INT AS line, text FROM r WHERE k <= 6"""

_CANDIDATES = ORACLES["context_lines"][ORACLES["context_lines"].index(", f AS (SELECT") + 2:ORACLES["context_lines"].index(",\n    r AS (SELECT")]
ORACLES["planned_prompts"] = f"""WITH unit AS ({_UNITS}), whole AS ({_POS} {_HINTS}, {_RELATED}, {_CANDIDATES},
    beside AS (SELECT u.path, u.pos, c.place, c.text, row_number() OVER (PARTITION BY u.path, u.pos ORDER BY least(abs(c.place - u.first), abs(c.place - u.last)), c.place) AS k
        FROM unit u JOIN cand c ON c.path = u.path AND c.pos = u.pos AND (c.place < u.first OR c.place > u.last) WHERE c.text IS NOT NULL),
    lines AS (SELECT path, pos, chr(10) || 'OTHER LINES THAT USE THE SAME NAMES (from elsewhere in the function):' || chr(10) || string_agg('line ' || place || ': ' || text, chr(10) ORDER BY place) || chr(10) AS block FROM beside WHERE k <= 6 GROUP BY ALL),
    blocks AS (SELECT p, list(block ORDER BY place) AS b FROM kept GROUP BY p),
    base AS (SELECT u.path, u.pos, u.kind, u.first, u.place, lines.block, b, 'Review this code.' || chr(10) || 'CODE UNDER REVIEW (function ''' || i.name || ''', lines ' || u.first || '-' || u.last || ' of ' || regexp_extract(u.path, '[^/]+$') || ')' || chr(10)
            || array_to_string(list_transform(range(u.first, u.last + 1), lambda n: lpad(n::VARCHAR, length(u.last::VARCHAR)::INT, ' ') || ' | ' || string_split(i.source, chr(10))[(n - i.first + 1)::BIGINT]), chr(10)) || chr(10)
            || chr(10) || 'LINES THAT RULES MATCHED (some may be harmless):' || chr(10) || 'line ' || h.line || ': ' || h.description || chr(10) AS base
        FROM unit u JOIN item i ON i.path = u.path AND i.pos = u.pos JOIN hints h ON h.path = u.path AND h.pos = u.pos AND h.kind = u.kind
            LEFT JOIN lines ON lines.path = u.path AND lines.pos = u.pos LEFT JOIN blocks ON blocks.p = i.p),
    r0 AS (SELECT path, pos, kind, first, place, b, CASE WHEN length(base) + length(block) <= 2764 THEN base || block ELSE base END AS t, 0 AS n FROM base), {", ".join(map(_with_block, range(1, 9)))}
    SELECT path, pos, kind, first, place, n::INT AS n_related, md5(rtrim(t, E' \\t\\n\\r\\x0b\\f') || chr(10)) AS prompt_md5 FROM r8) SELECT * FROM whole"""

# A file's document from the answers of the queries that it is made of.
_PARTS = ", ".join(f"{name} AS ({_KNOWN[name]})" for name in (
    "contents_sentence", "dependency_sentence", "impact_sentence", "listed_symbols", "function_score", "important_functions", "extract_chunks", "signatures", "constants"))
ORACLES["file_document"] = f"""WITH {_PARTS},
    called AS ({_POS} {_EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY path, pos ORDER BY o, callee_path, callee_pos) AS k FROM (
            SELECT path, pos, callee_path, callee_pos, callee, min(o) OVER (PARTITION BY path, pos, callee) AS o FROM edges))
        SELECT path, pos, list(callee ORDER BY k) AS l FROM k WHERE k <= 4 GROUP BY ALL),
    entry AS (SELECT i.path, i.place, '- **`' || c.name || '`** (lines ' || c.start_line || '-' || c.end_line || '): `' || g.signature || '`'
            || (CASE WHEN l IS NULL THEN '' ELSE chr(10) || '  - Calls: ' || array_to_string(list_filter(l, lambda x, j: list_position(l, x) = j), ', ') END)
            || chr(10) || '  - Why it matters: ' || (CASE WHEN reasons = '' THEN 'It is one of the larger functions of the file.' ELSE replace(reasons, '; ', ' ') END) AS e
        FROM important_functions i JOIN extract_chunks c USING (path, pos) JOIN signatures g USING (path, pos) JOIN function_score f USING (path, pos) LEFT JOIN called USING (path, pos)),
    entries AS (SELECT path, string_agg(e, chr(10) ORDER BY place) AS e FROM entry GROUP BY path),
    held AS (SELECT path, string_agg('- `' || name || '`', chr(10) ORDER BY line) AS k FROM constants GROUP BY path)
    SELECT path, '## ' || path || chr(10) || chr(10) || c.sentence || ' ' || d.sentence || ' ' || i.sentence
        || coalesce(chr(10) || chr(10) || '**Important functions**' || chr(10) || chr(10) || e, '')
        || coalesce(chr(10) || chr(10) || '**Everything it defines**' || chr(10) || chr(10) || '- `' || replace(signatures, '; ', '`' || chr(10) || '- `') || '`', '')
        || (CASE WHEN n_more > 0 THEN chr(10) || '- ...and ' || n_more || ' more' ELSE '' END)
        || coalesce(chr(10) || chr(10) || '**Constants**' || chr(10) || chr(10) || k, '') AS report
    FROM contents_sentence c JOIN dependency_sentence d USING (path) JOIN impact_sentence i USING (path) LEFT JOIN entries USING (path) LEFT JOIN listed_symbols USING (path) LEFT JOIN held USING (path)"""
