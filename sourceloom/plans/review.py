"""The review plan: which windows of which chunks are asked about, in what order, with what beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import facts, signals
from ..operators.prompts import review_prompt, reviewed_part
from ..operators.ranking import numbered
from ..scratch import cut_lineage

# Words of the languages, which say nothing about a flagged line.
IGNORED_NAMES = (
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "goto", "try", "catch", "throw", "const", "static", "auto", "void",
    "int", "char", "bool", "long", "short", "unsigned", "signed", "float", "double", "size_t", "true", "false", "nullptr", "new", "delete", "sizeof", "this",
    "struct", "class", "enum", "typename", "template", "namespace", "using", "std", "static_cast", "reinterpret_cast", "const_cast", "dynamic_cast",
    "def", "elif", "in", "not", "and", "or", "is", "None", "True", "False", "self", "lambda", "pass", "raise", "with", "as", "from", "import", "len", "range", "print", "str",
)
_NAME = r"([A-Za-z_]\w*)"


def context_lines(code_lines: Column, source_lines: Column, start: Column, first: Column, last: Column, flagged: Column, language: Column, most: int = rules.CONTEXT_LINES) -> Column:
    """Lines of a chunk outside a window that use a name of its flagged lines and give it a value, check it or belong
    to the signature: the closest ones (ties: the upper one), in line order, as structs of line and text."""
    beside = lambda code, source: _beside(code, source, start, first, last, flagged, language, most)
    return T.let(code_lines, lambda code: T.let(source_lines, lambda source: beside(code, source)))


def _beside(code_lines: Column, source_lines: Column, start: Column, first: Column, last: Column, flagged: Column, language: Column, most: int) -> Column:
    opens = lambda x: F.when(language == "Python", F.endswith(F.rtrim(x), F.lit(":"))).otherwise(F.contains(x, F.lit("{")))
    body_at = F.array_position(F.transform(code_lines, opens), True).cast("int")
    body = F.when(body_at > 0, body_at - 1).otherwise(F.size(code_lines))
    used = F.flatten(F.transform(flagged, lambda n: F.regexp_extract_all(F.get(code_lines, n - start), F.lit(_NAME), 1)))
    names = F.array_except(used, F.array(*map(F.lit, IGNORED_NAMES)))

    def found(names: Column) -> Column:
        return T.let(body, lambda b: near_lines(names, b))

    def near_lines(names: Column, body: Column) -> Column:
        assigned = F.concat(F.lit(r"\b(?:"), F.array_join(names, "|"), F.lit(r")\b"), F.lit(rules.ASSIGNMENT))

        def wanted(k: Column) -> Column:
            code, number = F.get(code_lines, k), start + k
            outside = (number < first) | (number > last)
            mentioned = F.arrays_overlap(F.regexp_extract_all(code, F.lit(_NAME), 1), names)
            return outside & mentioned & (F.regexp_like(code, assigned) | F.regexp_like(code, F.lit(rules.CHECK)) | (k <= body))

        places = F.filter(F.sequence(F.lit(0), F.size(code_lines) - 1), wanted)
        near = F.array_sort(F.transform(places, lambda k: F.struct(F.least(F.abs(start + k - first), F.abs(start + k - last)).alias("d"), (start + k).alias("line"))))
        lines = F.transform(F.slice(near, 1, most), lambda x: F.struct(x["line"].alias("line"), T.shorten(F.get(source_lines, x["line"] - start)).alias("text")))
        return F.array_sort(lines)

    return F.when(F.size(names) > 0, T.let(names, found)).otherwise(F.array().cast("array<struct<line:int,text:string>>"))


def _limited(hints: Column) -> Column:
    """The best hints of one window: two per description, eight in all, in line order."""
    def pick(ordered: Column) -> Column:
        fresh = F.filter(ordered, lambda h, k: F.size(F.filter(F.slice(ordered, F.lit(1), k), lambda x: x["description"] == h["description"])) < rules.HINTS_PER_SIGNAL)
        kept = F.slice(fresh, 1, rules.MAX_HINTS)
        return F.array_sort(F.transform(kept, lambda h: F.struct(h["line"], h["signal_ord"], h["description"], h["points"])))

    order = F.transform(hints, lambda h: F.struct((-h["points"]).alias("p"), h["line"], h["signal_ord"], h["description"], h["points"]))
    return T.let(F.array_sort(order), pick)


def _points(hints: Column) -> Column:
    """Each description counts once, with its most points."""
    names = F.array_distinct(F.transform(hints, lambda h: h["description"]))
    best = F.transform(names, lambda d: F.array_max(F.transform(F.filter(hints, lambda h: h["description"] == d), lambda h: h["points"])))
    return F.aggregate(best, F.lit(0), lambda s, x: s + x)


def _listed(items: Column, field: str) -> Column:
    return F.transform(items, lambda h: F.concat(F.lit("line "), h["line"], F.lit(": "), h[field]))


def _with_enclosing(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds enclosing: a sentence on the chunk that a chunk is defined in, empty without one."""
    around = chunks.select("repo", "path", F.col("pos").alias("parent"), F.format_string(rules.ENCLOSING, "symbol_type", "name").alias("enclosing"))
    return rows.join(around.hint("merge"), ["repo", "path", "parent"], "left").withColumn("enclosing", F.coalesce("enclosing", F.lit("")))


def _shown(kept: Column) -> tuple[Column, Column, Column]:
    """The heading, the numbered lines and the flagged lines of a unit: a window (first, last) of a chunk."""
    shown = F.slice(T.lines_of(F.col("source")), F.col("first") - F.col("start_line") + 1, F.col("last") - F.col("first") + 1)
    width = F.length(F.col("last").cast("string"))
    code = F.array_join(F.transform(shown, lambda x, k: F.concat(F.lpad((F.col("first") + k).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")
    header = F.format_string("CODE UNDER REVIEW (%s '%s', lines %d-%d of %s)", F.col("symbol_type"), F.col("name"), F.col("first"), F.col("last"), F.element_at(F.split("path", "/", -1), -1))
    return F.concat(header, "enclosing"), code, _listed(kept, "description")


def review_plan(scanned: DataFrame, hot: DataFrame, instruction: str = "Review this code.", budget: int = rules.REVIEW_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Review units in order, and the windows that cannot be reviewed.

    Functions and leaves with hints are reviewed: whole up to 1500 characters, else in windows; a longer container is
    left to what it holds. A window gives a security unit (hints and chunk context) and a performance unit (hints and
    two points if hot); units whose code and flagged lines do not fit are dropped. place is the order within the repository.
    Prompts are not part of the plan: plan_prompts builds those of the units that are kept.
    """
    keys = ["repo", "path", "pos"]
    rows = facts.context_scores(scanned).where((F.col("symbol_type").isin("function", "method") | ~F.col("is_container")) & (F.size("hints") > 0))
    rows = _with_enclosing(rows, scanned).join(hot.select(*keys, F.lit(True).alias("is_hot")).distinct().hint("merge"), keys, "left")
    lines = T.lines_of(F.col("source"))
    short = F.length("source") <= rules.WHOLE_CHUNK_CHARS
    last = F.col("start_line") + F.size(lines) - 1
    whole = F.array(F.struct(F.col("start_line").alias("first"), last.alias("last")))
    windows = F.when(short, whole).otherwise(signals.focus_windows(F.transform("hints", lambda h: h["line"]), F.col("start_line"), last))
    left_out = F.col("is_container") & ~short
    skipped = rows.where(left_out).select(*keys, F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    each = rows.where(~left_out).withColumn("w", F.explode(windows)).withColumn("first", F.col("w.first")).withColumn("last", F.col("w.last"))
    each = each.withColumn("kind", F.explode(F.array(F.lit("SECURITY"), F.lit("PERFORMANCE"))))
    mine = F.filter("hints", lambda h: (h["kind"] == F.col("kind")) & (h["line"] >= F.col("first")) & (h["line"] <= F.col("last")))
    units = each.withColumn("kept", _limited(mine)).where(F.size("kept") > 0)
    extra = F.when(F.col("kind") == "SECURITY", F.col("context_points")).when(F.col("is_hot"), 2).otherwise(0)
    context = context_lines(F.split("code", "\n", -1), lines, F.col("start_line"), F.col("first"), F.col("last"), F.transform("kept", lambda h: h["line"]), F.col("language"))
    units = units.withColumn("score", (_points(F.col("kept")) + extra).cast("int")).withColumn("context", context)
    base = reviewed_part(F.lit(instruction), *_shown(F.col("kept")))
    made = cut_lineage(units.select(*keys, "kind", "first", "last", "score", "kept", "context", (F.length(base) <= budget).alias("fits")))
    fits = made.where("fits")
    # ranks are found of keys and scores alone; hints and lines beside come back by a join on the unit
    unit = [*keys, "kind", "first"]
    places = numbered(fits.select(*unit, "score"), ["repo"], [F.desc("score"), "path", "pos", "first", "kind"], "place").drop("score").withColumn("place", F.col("place").cast("int"))
    plan = fits.join(places.hint("merge"), unit).select(*keys, "kind", "first", "last", "score", "kept", "context", "place")
    unfit = made.groupBy(*keys, "first", "last").agg(F.bool_and(~F.col("fits")).alias("none")).where("none").drop("none")
    return plan, skipped.unionByName(unfit)


def plan_prompts(plan: DataFrame, chunks: DataFrame, related: DataFrame | None = None, instruction: str = "Review this code.", budget: int = rules.REVIEW_BUDGET) -> DataFrame:
    """The plan with the prompt of each unit and n_related, how many related blocks it holds (at most three, each whole).

    chunks has the keys, parent, name, symbol_type, start_line and source of all chunks, those that enclose others included; related has the keys and related, blocks in the order in which they are tried
    (see related_code). A unit without related blocks, or without room for one, has none. Give the instruction and budget of the plan.
    """
    keys = ["repo", "path", "pos"]
    none = F.array().cast("array<string>")
    rows = _with_enclosing(plan.join(chunks.select(*keys, "parent", "name", "symbol_type", "start_line", "source").hint("merge"), keys), chunks)
    rows = rows.withColumn("related", none) if related is None else rows.join(related.select(*keys, "related").hint("merge"), keys, "left")
    made = review_prompt(F.lit(instruction), *_shown(F.col("kept")), _listed(F.col("context"), "text"), F.coalesce("related", none), budget)
    return rows.withColumn("_made", made).select(*plan.columns, F.col("_made.prompt").alias("prompt"), F.col("_made.n_related").alias("n_related"))


def file_document(found: DataFrame, important: DataFrame, callees: DataFrame, listed: DataFrame) -> DataFrame:
    """repo, path and report: a file's sentences, important functions, signatures and constants as markdown."""
    keys = ["repo", "path"]
    entry = F.concat(
        F.format_string("- **`%s`** (lines %d-%d): `%s`", F.col("name"), F.col("start_line"), F.col("end_line"), F.col("signature")),
        F.when(F.size("names") > 0, F.concat(F.lit("\n  - Calls: "), F.array_join("names", ", "))).otherwise(""),
        F.lit("\n  - Why it matters: "), F.when(F.size("reasons") > 0, F.array_join("reasons", " ")).otherwise("It is one of the larger functions of the file."))
    entries = important.join(callees, ["repo", "path", "pos"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))).alias("entries"))
    rows = found.join(entries, keys, "left").join(listed, keys, "left")
    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n**{title}**\n\n"), F.array_join(items, "\n"))).otherwise("")
    ticked = lambda c: F.transform(c, lambda x: F.concat(F.lit("- `"), x, F.lit("`")))
    more = F.when(F.col("n_more") > 0, F.concat(F.lit("\n- ...and "), F.col("n_more"), F.lit(" more"))).otherwise("")
    text = F.concat(
        F.lit("## "), "path", F.lit("\n\n"), F.concat_ws(" ", facts.contents_sentence(found), facts.dependency_sentence(found), facts.impact_sentence(found)),
        part("Important functions", F.transform("entries", lambda x: x["e"])), part("Everything it defines", ticked(F.col("signatures"))), more, part("Constants", ticked(F.col("constants"))))
    return rows.select(*keys, text.alias("report"))
