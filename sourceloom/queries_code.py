"""Extraction, signals, graph and facts over the code corpus of plans.code_view, with SQL that computes the answers from columns."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from .functions import text as T
from .operators import facts, graph, signals
from .plans.code_view import FACTS, code_files
from .scratch import stored
from .sources import extract as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["repo", "path", "pos"]
_BUILT: dict = {}


def anew(function):
    """A query that shares no table with the ones before it."""

    @functools.wraps(function)
    def run(spark, sf_dir):
        _BUILT.clear()
        return function(spark, sf_dir)

    return run


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = anew(function)
        if sql:
            ORACLES[function.__name__] = f"WITH {FACTS}, pos AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY p) - 1)::INT AS pos FROM fn) {sql}"
        return function

    return add


def once(build):
    """Build a table that several parts of a query read only once; each query starts anew."""

    def get(spark, sf_dir):
        key = (build.__name__, sf_dir)
        if key not in _BUILT:
            _BUILT[key] = build(spark, sf_dir)
        return _BUILT[key]

    return get


@once
def _extracted(spark, sf_dir):
    return stored(X.extract(code_files(spark, sf_dir)), "extracted")


@once
def _imports(spark, sf_dir):
    """What the graph of files needs of the extraction; sources and definitions are not stored for it."""
    return stored(X.extract(code_files(spark, sf_dir)).select("repo", "path", "error", "includes"), "imports")


def _chunks(spark, sf_dir):
    return X.chunks_of(_extracted(spark, sf_dir))


@once
def _scanned(spark, sf_dir):
    return stored(signals.scan_chunks(_chunks(spark, sf_dir)), "scanned")


@query("SELECT path, pos, name, language, 'function' AS symbol_type, first::INT AS start_line, (first + n_lines - 1)::INT AS end_line FROM pos")
def extract_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "pos", "name", "language", "symbol_type", "start_line", "end_line")


@query("SELECT path, pos, name AS short_name, CASE WHEN language = 'Python' THEN 'def ' || name || '(a, x)' ELSE 'int ' || name || '(int* a, int x)' END AS signature FROM pos")
def signatures(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "pos", "short_name", "signature")


_CALLED = """, named AS (SELECT caller AS p, name, 100 + callee AS o FROM call UNION ALL
    SELECT p, CASE WHEN language = 'Python' THEN (['eval', 'loads', 'open'])[kind + 1] ELSE (['strcpy', 'atoi', 'push_back'])[kind + 1] END, 2 FROM fn WHERE kind < 3
    UNION ALL SELECT p, 'reserve', 1 FROM fn WHERE kind = 2 AND even AND language = 'C++')
    SELECT path, pos, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS ord, n.name AS called
    FROM (SELECT p, name, min(o) AS o FROM named GROUP BY ALL) n JOIN pos USING (p)"""


@query(_CALLED)
def called_names(spark, sf_dir):
    return _chunks(spark, sf_dir).select("path", "pos", F.posexplode("called_names").alias("ord", "called"))


_INCLUDES = """, near AS (SELECT f.*, 'd' || (f.near % 10) || '/m' || f.near || (CASE WHEN f.near % 2 = 0 THEN '.py' WHEN f.near % 6 = 1 THEN '.h' ELSE '.cpp' END) AS near_file FROM file f),
    inc AS (SELECT path, CASE WHEN language = 'Python' THEN 'os' ELSE 'vector' END AS target, language = 'C++' AS is_system, 1 AS line, 'external' AS kind, CASE WHEN language = 'Python' THEN 'os' ELSE 'vector' END AS dependency FROM file
    UNION ALL SELECT f.path, CASE WHEN f.language = 'Python' THEN 'm' || f.target ELSE replace(g.path, 'repo/', '') END, false, 2, CASE WHEN f.target <> f.s THEN 'internal' ELSE 'external' END,
        CASE WHEN f.target <> f.s THEN g.path WHEN f.language = 'Python' THEN 'm' || f.target ELSE replace(g.path, 'repo/', '') END FROM file f JOIN file g ON g.s = f.target WHERE f.imports
    UNION ALL SELECT path, 'numpy.linalg', false, 2 + imports::INT, 'external', 'numpy' FROM file WHERE s % 6 = 0
    UNION ALL SELECT path, 'yaml', false, 2 + imports::INT + (s % 6 = 0)::INT, 'external', 'yaml' FROM file WHERE s % 10 = 0
    UNION ALL SELECT path, CASE WHEN language = 'C++' THEN '../' || near_file WHEN s % 4 = 0 THEN '..d' || (near % 10) || '.m' || near ELSE '.m' || near END, false, head - 1,
        CASE WHEN near < n THEN 'internal' WHEN language = 'Python' THEN 'local' ELSE 'external' END,
        CASE WHEN near < n THEN 'repo/' || near_file WHEN language = 'C++' THEN '../' || near_file WHEN s % 4 = 0 THEN '..d' || (near % 10) || '.m' || near ELSE '.m' || near END FROM near, n),
    res AS (SELECT DISTINCT path, target, kind, dependency FROM inc),
    edge AS (SELECT DISTINCT path, dependency FROM res WHERE kind = 'internal')"""


@query(_INCLUDES + " SELECT path, target, is_system, line FROM inc")
def includes(spark, sf_dir):
    return X.includes_of(_extracted(spark, sf_dir)).select("path", "target", "is_system", "line")


@query("SELECT path, 'K_' || s AS name, head::INT AS line FROM file")
def constants(spark, sf_dir):
    return X.constants_of(_extracted(spark, sf_dir)).select("path", "name", "line")


@query("SELECT name AS short_name, n_same FROM share WHERE n_same <= 3 AND length(name) >= 4")
def trusted_names(spark, sf_dir):
    return graph.trusted_names(_chunks(spark, sf_dir)).select("short_name", "n_same")


_EDGES = """, edges AS (SELECT a.path, a.pos, a.name AS caller, b.path AS callee_path, b.pos AS callee_pos, b.name AS callee, a.p AS ap, b.p AS bp, min(c.callee) AS o,
        CASE WHEN b.language = 'Python' THEN 'def ' || b.name || '(a, x)' ELSE 'int ' || b.name || '(int* a, int x)' END AS signature
    FROM call c JOIN share USING (name) JOIN pos a ON a.p = c.caller JOIN pos b ON b.name = c.name AND b.language = a.language AND b.p <> a.p WHERE n_same <= 3 GROUP BY ALL)"""


@query(_EDGES + " SELECT path, pos, caller, callee_path, callee_pos, callee FROM edges")
def call_edges(spark, sf_dir):
    return graph.call_edges(_chunks(spark, sf_dir)).select("path", "pos", "caller", "callee_path", "callee_pos", "callee")


@query(_EDGES + """, k AS (SELECT *, row_number() OVER (PARTITION BY path, pos ORDER BY o, callee_path, callee_pos) AS k FROM (
        SELECT path, pos, callee_path, callee_pos, signature, callee, min(o) OVER (PARTITION BY path, pos, callee) AS o FROM edges))
    SELECT path, pos, string_agg(signature, '; ' ORDER BY k) AS signatures FROM k WHERE k <= 4 GROUP BY ALL""")
def callees_of(spark, sf_dir):
    return graph.callees_of(graph.call_edges(_chunks(spark, sf_dir))).select("path", "pos", F.array_join("signatures", "; ").alias("signatures"))


_CALLERS = _EDGES + """, c AS (SELECT callee_path, callee_pos, count(*) AS n_callers, count(DISTINCT CASE WHEN path <> callee_path THEN path END) AS n_other_files FROM edges GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY callee_path, callee_pos ORDER BY path, pos) AS k FROM edges),
    l AS (SELECT callee_path, callee_pos, string_agg(caller || ' in ' || regexp_extract(path, '[^/]*$'), ', ' ORDER BY k) AS l FROM k WHERE k <= 3 GROUP BY ALL),
    summary AS (SELECT callee_path AS path, callee_pos AS pos, n_callers, n_other_files,
    'It is called by ' || n_callers || ' function' || (CASE WHEN n_callers = 1 THEN '' ELSE 's' END) || ' (' || l || (CASE WHEN n_callers > 3 THEN ' and ' || (n_callers - 3) || ' more' ELSE '' END) || ')'
    || (CASE WHEN n_other_files > 0 THEN ', ' || n_other_files || ' of them in other files' ELSE '' END) || '.' AS summary FROM c JOIN l USING (callee_path, callee_pos))"""


@query(_CALLERS + " SELECT * FROM summary")
def callers_summary(spark, sf_dir):
    return graph.callers_of(graph.call_edges(_chunks(spark, sf_dir))).select("path", "pos", "n_callers", "n_other_files", "summary")


@query(""", h AS (SELECT b.path, b.pos, b.name AS callee, a.path AS caller_path, a.pos AS ap, a.name AS caller, c.line::INT AS line,
        row_number() OVER (PARTITION BY b.p ORDER BY a.path, a.pos, c.line) AS k
    FROM call c JOIN share USING (name) JOIN pos a ON a.p = c.caller JOIN pos b ON b.name = c.name AND b.p <> a.p WHERE n_same <= 3 AND c.loop)
    SELECT path, pos, callee, caller_path, caller, line FROM h WHERE k = 1""")
def hot_callees(spark, sf_dir):
    scanned = _scanned(spark, sf_dir)
    return graph.hot_callees(signals.loop_calls(scanned), _chunks(spark, sf_dir)).select("path", "pos", "callee", "caller_path", "caller", "line")


@once
def _resolved(spark, sf_dir):
    imports = _imports(spark, sf_dir)
    return graph.resolve_includes(X.includes_of(imports), imports.select("repo", "path"))


@query(_INCLUDES + " SELECT path, target, kind, dependency FROM res")
def resolve_includes(spark, sf_dir):
    return _resolved(spark, sf_dir).select("path", "target", "kind", "dependency")


@query(_INCLUDES + """, k AS (SELECT *, count(*) OVER (PARTITION BY dependency) AS n_users, ((row_number() OVER (PARTITION BY dependency ORDER BY path) - 1) // 2)::INT AS page FROM edge)
    SELECT dependency AS path, n_users, page, string_agg(path, ',' ORDER BY path) AS used_by FROM k GROUP BY ALL""")
def used_by(spark, sf_dir):
    """Pages are small here, so that some files have several."""
    edges = graph.file_edges(_resolved(spark, sf_dir))
    pages = graph.used_by_pages(edges, 2).select("repo", "path", "page", F.array_join("used_by", ",").alias("used_by"))
    return pages.join(graph.used_by(edges, 1).select("repo", "path", "n_users"), ["repo", "path"]).drop("repo")


@query(_INCLUDES + """ SELECT * FROM (SELECT dependency AS path, count(*) AS n_users, row_number() OVER (ORDER BY count(*) DESC, dependency)::INT AS place FROM edge GROUP BY dependency) WHERE place <= 4""")
def core_files(spark, sf_dir):
    return graph.core_files(graph.file_edges(_resolved(spark, sf_dir))).select("path", "n_users", "place")


@query(_INCLUDES + """, id AS (SELECT f, (row_number() OVER (ORDER BY f) - 1)::INT AS id FROM (SELECT path AS f FROM edge UNION SELECT dependency FROM edge)),
    r AS (SELECT *, row_number() OVER (ORDER BY path, dependency) AS k, count(*) OVER () > 40 AS is_cut FROM edge)
    SELECT path, dependency, a.id AS from_id, b.id AS to_id, k::INT AS k, is_cut FROM r JOIN id a ON a.f = path JOIN id b ON b.f = dependency WHERE k <= 40""")
def dependency_edges(spark, sf_dir):
    return graph.dependency_edges(graph.file_edges(_resolved(spark, sf_dir))).select("path", "dependency", "from_id", "to_id", "k", "is_cut")


@query(_INCLUDES + """, used AS (SELECT DISTINCT split_part(target, '.', 1) AS package, path FROM inc WHERE suffix(path, '.py') AND target NOT LIKE '.%' AND target <> 'os' AND NOT regexp_matches(target, '^m[0-9]+$')),
    k AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY path) AS k, ((row_number() OVER (PARTITION BY package ORDER BY path) - 1) // 20)::INT AS page FROM used),
    first AS (SELECT package, min(path) AS path FROM used GROUP BY package),
    line AS (SELECT package, f.path, min(line) AS line FROM first f JOIN inc ON inc.path = f.path AND split_part(inc.target, '.', 1) = package GROUP BY ALL)
    SELECT package, CASE package WHEN 'numpy' THEN 'numpy-lib' ELSE package END AS install_name, package = 'numpy' AS is_required, (SELECT count(*) FROM used u WHERE u.package = l.package) AS n_files,
        dense_rank() OVER (ORDER BY l.path, line, package)::INT AS place, page, string_agg(regexp_extract(k.path, '[^/]*$'), ',' ORDER BY k) AS files
    FROM line l JOIN k USING (package) GROUP BY package, l.path, line, page""")
def import_inventory(spark, sf_dir):
    extracted = _extracted(spark, sf_dir)
    packages = graph.import_inventory(X.includes_of(extracted), extracted.select("repo", "path"), ("os", "sys", "re"), {"numpy": "numpy-lib"}, ("numpy",), 20)
    return packages.select("package", "install_name", "is_required", "n_files", "place", "page", F.array_join("files", ",").alias("files"))


_HINTS = """, sec AS (SELECT path, pos, (first + 1)::INT AS line, 'SECURITY' AS kind, CASE WHEN language = 'Python' THEN (['runs dynamic code', 'unsafe deserialisation'])[kind + 1]
        ELSE (['raw memory/C-string calls', 'parses numbers from text'])[kind + 1] END AS description,
        CASE WHEN language = 'Python' THEN 4 ELSE 3 - kind END::INT AS points, CASE WHEN language = 'Python' THEN 2 * kind ELSE 2 * kind END::INT AS signal_ord,
        CASE WHEN language = 'Python' THEN (['eval(x)', 'pickle.loads(x)'])[kind + 1] ELSE (['strcpy(a, b);', 'atoi(a);'])[kind + 1] END AS text FROM pos WHERE kind < 2),
    perf AS (SELECT path, pos, (first + 2)::INT AS line, 'PERFORMANCE' AS kind, CASE WHEN language = 'Python' THEN 'opens or reads a file inside a loop' ELSE 'grows a container in a loop without reserving space' END AS description,
        CASE WHEN language = 'Python' THEN 3 ELSE 2 END::INT AS points, CASE WHEN language = 'Python' THEN 1 ELSE 5 END::INT AS signal_ord, CASE WHEN language = 'Python' THEN 'open(x)' ELSE 'a.push_back(i);' END AS text
        FROM pos WHERE kind = 2 AND (language = 'Python' OR NOT even)),
    hints AS (SELECT * FROM sec UNION ALL SELECT * FROM perf)"""


@query(_HINTS + " SELECT path, pos, line, description, points, text FROM sec")
def security_hints(spark, sf_dir):
    hints = signals.hint_rows(_scanned(spark, sf_dir), KEYS).where("kind = 'SECURITY'")
    return hints.select("path", "pos", "line", "description", "points", "text")


@query(_HINTS + " SELECT path, pos, line, description, points, text FROM perf")
def performance_hints(spark, sf_dir):
    hints = signals.hint_rows(_scanned(spark, sf_dir), KEYS).where("kind = 'PERFORMANCE'")
    return hints.select("path", "pos", "line", "description", "points", "text")


@query(_HINTS + """, d AS (SELECT path, description, max(points) AS points, min(signal_ord * 1000000 + line) AS o FROM hints GROUP BY ALL)
    SELECT path, sum(points)::BIGINT AS score, string_agg(description, '; ' ORDER BY o) AS reasons FROM d GROUP BY path""")
def hint_score(spark, sf_dir):
    scored = signals.hint_score(signals.hint_rows(_scanned(spark, sf_dir), KEYS), ["repo", "path"])
    return scored.select("path", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(_HINTS + """, a AS (SELECT *, row_number() OVER (PARTITION BY path, description ORDER BY points DESC, line, signal_ord) AS k FROM hints),
    b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY points DESC, line, signal_ord) AS j FROM a WHERE k <= 2)
    SELECT path, line, description, points FROM b WHERE j <= 8""")
def limit_hints(spark, sf_dir):
    return signals.limit_hints(signals.hint_rows(_scanned(spark, sf_dir), KEYS), ["repo", "path"]).select("path", "line", "description", "points")


@query(_HINTS + """, total AS (SELECT path, max(first + n_lines)::INT AS last FROM fn GROUP BY path),
    o AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM (SELECT DISTINCT path, line FROM hints)),
    w AS (SELECT o.path, o.k, greatest(1, line - 12) AS a, least(last, line + 12) AS b FROM o JOIN total USING (path)),
    fold AS (WITH RECURSIVE r AS (SELECT path, k, a AS first, b AS last, 1 AS g FROM w WHERE k = 1
        UNION ALL SELECT w.path, w.k, CASE WHEN w.a <= r.last + 1 AND w.b - r.first + 1 <= 60 THEN r.first ELSE w.a END,
            CASE WHEN w.a <= r.last + 1 AND w.b - r.first + 1 <= 60 THEN greatest(r.last, w.b) ELSE w.b END,
            r.g + (NOT (w.a <= r.last + 1 AND w.b - r.first + 1 <= 60))::INT FROM r JOIN w ON w.path = r.path AND w.k = r.k + 1) SELECT * FROM r)
    SELECT path, first::INT AS first, max(last)::INT AS last FROM fold GROUP BY path, g, first""")
def focus_windows(spark, sf_dir):
    scanned = _scanned(spark, sf_dir)
    lines = signals.hint_rows(scanned, KEYS).groupBy("repo", "path").agg(F.collect_set("line").alias("lines"))
    last = scanned.groupBy("repo", "path").agg((F.max("end_line") + 1).alias("end"))
    windows = signals.focus_windows(F.col("lines"), F.lit(1), F.col("end"))
    return lines.join(last, ["repo", "path"]).select("path", F.inline(windows))


_DEPTH = """, d AS (SELECT caller AS p, line FROM call WHERE loop UNION ALL SELECT caller, line + 1 FROM call WHERE loop AND language = 'C++'
    UNION ALL SELECT p, first + 2 + (even AND language = 'C++')::INT FROM fn WHERE kind = 2 UNION ALL SELECT p, first + 3 + even::INT FROM fn WHERE kind = 2 AND language = 'C++')
    SELECT path, pos, d.line::INT AS line FROM d JOIN pos USING (p) WHERE language = """


def _depths(spark, sf_dir, language):
    rows = _scanned(spark, sf_dir).where(F.col("language") == language)
    return rows.select("path", "pos", "start_line", F.posexplode("depths").alias("k", "depth")).where("depth = 1").select("path", "pos", (F.col("start_line") + F.col("k")).alias("line"))


@query(_DEPTH + "'Python'")
def loop_depth_python(spark, sf_dir):
    return _depths(spark, sf_dir, "Python")


@query(_DEPTH + "'C++'")
def loop_depth_cpp(spark, sf_dir):
    return _depths(spark, sf_dir, "C++")


_EFFECTS = ", eff AS (SELECT path, language, CASE WHEN language = 'Python' AND bool_or(kind = 2) THEN 'reads or writes files' ELSE '' END AS effects FROM fn GROUP BY path, language)"


@query(_EFFECTS + " SELECT * FROM eff")
def file_effects(spark, sf_dir):
    return signals.file_effects(_chunks(spark, sf_dir)).select("path", "language", F.array_join("effects", "; ").alias("effects"))


@query(" SELECT path, count(*) AS n FROM fn WHERE kind > 2 OR (kind = 2 AND even AND language = 'C++') GROUP BY ROLLUP (path)")
def unflagged_by_file(spark, sf_dir):
    return _scanned(spark, sf_dir).where(F.size("hints") == 0).rollup("path").agg(F.count("*").alias("n"))


_CONTEXT = """, b AS (SELECT p, count(*) FILTER (call.loop) AS n, bool_or(call.name = fn.name) AS again FROM fn LEFT JOIN call ON caller = p GROUP BY p)
    SELECT path, pos, (CASE WHEN again THEN 2 ELSE 0 END + CASE WHEN n + (kind = 2)::INT >= 20 THEN 2 WHEN n + (kind = 2)::INT >= 8 THEN 1 ELSE 0 END)::INT AS points,
    concat_ws('; ', CASE WHEN again THEN 'may recurse' END, CASE WHEN n + (kind = 2)::INT >= 20 THEN 'many branches' WHEN n + (kind = 2)::INT >= 8 THEN 'several branches' END) AS reasons FROM pos JOIN b USING (p)"""


@query(_CONTEXT)
def chunk_context_score(spark, sf_dir):
    return facts.context_scores(_scanned(spark, sf_dir)).select("path", "pos", F.col("context_points").alias("points"), F.array_join("context_reasons", "; ").alias("reasons"))


@query(" SELECT path, pos, true AS is_public, '' AS special FROM pos")
def public_functions(spark, sf_dir):
    kind = facts.is_public(F.col("language"), F.col("symbol_type"), F.col("short_name"), F.col("signature"))
    return _chunks(spark, sf_dir).select("path", "pos", kind.alias("is_public"), facts.special_member(F.col("language"), F.col("signature")).alias("special"))


@query(""" SELECT path, pos, CASE s % 4 WHEN 0 THEN 'constructor' WHEN 1 THEN 'destructor' ELSE '' END AS special FROM pos WHERE language = 'C++' AND s % 4 <> 3
    UNION ALL SELECT path, pos, '' FROM pos WHERE language = 'Python' OR s % 4 = 3""")
def special_members(spark, sf_dir):
    s = F.regexp_extract("path", "m([0-9]+)", 1).cast("long")
    signature = F.when((F.col("language") == "C++") & (s % 4 == 1), F.concat("name", F.lit("::~"), "name", F.lit("()"))).otherwise(F.concat(F.lit("int A::"), "name", F.lit("(int a)")))
    return _chunks(spark, sf_dir).select("path", "pos", facts.special_member(F.col("language"), signature).alias("special"))


_SCORE = _CALLERS + """, scored AS (SELECT pos.path, pos.pos, pos.first, coalesce(n_callers, 0)::BIGINT AS n_callers, (least(10, 2 * coalesce(n_callers, 0)) + 2 + least(2, n_lines // 15))::BIGINT AS score,
    coalesce(summary, 'No caller was found in the code that was read. ' || CASE WHEN language = 'Python' THEN 'It is public: its name does not start with an underscore.'
        WHEN suffix(pos.path, '.h') THEN 'It is defined in a header file, so any file that includes it can use it.' ELSE 'It is not static, so other files can use it.' END) AS reasons
    FROM pos LEFT JOIN summary ON summary.path = pos.path AND summary.pos = pos.pos)"""


def _scored(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return facts.function_scores(chunks, graph.callers_of(graph.call_edges(chunks)))


@query(_SCORE + " SELECT path, pos, n_callers, score, reasons FROM scored")
def function_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("path", "pos", "n_callers", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(_SCORE + " SELECT * FROM (SELECT path, pos, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, first, pos)::INT AS place FROM scored) WHERE place <= 6")
def important_functions(spark, sf_dir):
    return facts.important_functions(_scored(spark, sf_dir)).select("path", "pos", "score", "place")


@query(""" SELECT path, string_agg(signature, '; ' ORDER BY pos) FILTER (pos < 30) AS signatures, greatest(count(*) - 30, 0)::BIGINT AS n_more
    FROM (SELECT path, pos, CASE WHEN language = 'Python' THEN 'def ' || name || '(a, x)' ELSE 'int ' || name || '(int* a, int x)' END AS signature FROM pos) GROUP BY path""")
def listed_symbols(spark, sf_dir):
    return facts.listed_symbols(_chunks(spark, sf_dir)).select("path", F.array_join("signatures", "; ").alias("signatures"), "n_more")


_FACTS = _INCLUDES + _EFFECTS + """, size AS (SELECT path, count(*) AS n_functions, sum(n_lines + 1) AS body FROM fn GROUP BY path),
    need AS (SELECT path, string_agg(DISTINCT dependency, ',' ORDER BY dependency) FILTER (kind = 'external') AS external, coalesce(string_agg(DISTINCT dependency, ',' ORDER BY dependency) FILTER (kind = 'internal'), '') AS internal,
        coalesce(string_agg(DISTINCT dependency, ',' ORDER BY dependency) FILTER (kind = 'local'), '') AS local FROM res GROUP BY path),
    users AS (SELECT dependency AS path, string_agg(path, ',' ORDER BY path) AS used_by FROM edge GROUP BY ALL),
    ff AS (SELECT file.path, file.language, (head + coalesce(body, 0) - 1 + (body IS NULL)::INT)::BIGINT AS line_count, coalesce(n_functions, 0)::BIGINT AS n_functions, 'K_' || s AS constants, external, internal, local,
        coalesce(used_by, '') AS used_by, coalesce(effects, '') AS effects FROM file LEFT JOIN size USING (path) JOIN need USING (path) LEFT JOIN users USING (path) LEFT JOIN eff USING (path))"""


def _facts(spark, sf_dir):
    extracted = _extracted(spark, sf_dir)
    chunks = X.chunks_of(extracted)
    resolved = graph.resolve_includes(X.includes_of(extracted), extracted.select("repo", "path"))
    return facts.file_facts(extracted, chunks, resolved, signals.file_effects(chunks))


@query(_FACTS + " SELECT * FROM ff")
def file_facts(spark, sf_dir):
    lists = [F.array_join(c, ",").alias(c) for c in ("constants", "external", "internal", "local", "used_by", "effects")]
    return _facts(spark, sf_dir).select("path", "language", "line_count", "n_functions", *lists)


@query(_FACTS + " SELECT 'repo' AS repo, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, 0::BIGINT AS n_entry_points, (SELECT string_agg(DISTINCT dependency, ',' ORDER BY dependency) FROM res WHERE kind = 'external') AS external FROM ff")
def repo_overview(spark, sf_dir):
    return facts.repo_overview(_facts(spark, sf_dir), _chunks(spark, sf_dir)).withColumn("n_lines", F.col("n_lines").cast("long"))


@query(_FACTS + """ SELECT path, 'This ' || language || ' file has ' || line_count || ' lines and defines ' || (CASE WHEN n_functions = 0 THEN '' WHEN n_functions = 1 THEN '1 function and ' ELSE n_functions || ' functions and ' END) || '1 constant.' AS sentence FROM ff""")
def contents_sentence(spark, sf_dir):
    found = _facts(spark, sf_dir)
    return found.select("path", facts.contents_sentence(found).alias("sentence"))


@query(_FACTS + """ SELECT path, CASE WHEN used_by = '' THEN 'No other file in the repository uses it' ELSE 'A change can affect the ' || len(u) || ' file' || (CASE WHEN len(u) = 1 THEN '' ELSE 's' END) || ' that use it ('
    || array_to_string(list_transform(u[1:6], lambda x: regexp_extract(x, '[^/]*$')), ', ') || ')' END || (CASE WHEN effects = '' THEN '' ELSE ', and its code ' || effects END) || '.' AS sentence FROM (SELECT *, string_split(used_by, ',') AS u FROM ff)""")
def impact_sentence(spark, sf_dir):
    found = _facts(spark, sf_dir)
    return found.select("path", facts.impact_sentence(found).alias("sentence"))


@query(_FACTS + """ SELECT path, 'It depends on ' || replace(external, ',', ', ') || ' from outside the repository' || (CASE WHEN internal = '' THEN '' ELSE (CASE WHEN local = '' THEN ' and ' ELSE ', ' END) || array_to_string(list_transform(string_split(internal, ','), lambda x: regexp_extract(x, '[^/]*$')), ', ') || ' from the repository' END)
    || (CASE WHEN local = '' THEN '' ELSE ' and ' || local || ' from the same folder' END) || '.' AS sentence FROM ff""")
def dependency_sentence(spark, sf_dir):
    found = _facts(spark, sf_dir)
    return found.select("path", facts.dependency_sentence(found).alias("sentence"))
