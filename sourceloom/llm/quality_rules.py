"""Quality rules as a table of thresholds, compiled into plain Spark expressions.

Everything is computed inside a row by built-in functions: no user functions, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as Java and SQL patterns and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Words in a window that counts as repeated.
WINDOW = 8

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "which de la le les et des un une du que en qui dans pour par sur est pas au avec il elle ce der die das und "
    "den von zu mit sich ein eine nicht ist im dem auf als auch es el los las y por con una para del al lo no se su".split()
)


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= metric <= high; a missing bound does not count."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are SQL over the measures of `measured`.
DEFAULT_RULES = (
    Rule("length", "n_words", low=20),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.3),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("word_length", "word_chars / n_words", low=2, high=12),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.4),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are compared by 64-bit hashes of their words. Where some are equal, they are sorted by hash; those
    with an equal neighbour are in it, and their places tell how many words they cover together.
    """
    n = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, k: F.when(k == F.size(places) - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(places, k + 1) - x)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def of_sorted(pairs: Column) -> Column:
        same = lambda pair, k: pair["h"].eqNullSafe(F.get(pairs, k)["h"])
        repeated = F.filter(pairs, lambda p, k: ((k > 0) & same(p, F.greatest(k - 1, F.lit(0)))) | same(p, k + 1))
        places = F.array_sort(F.transform(repeated, lambda p: p["i"]))
        return _bound(places, covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bound(pairs, of_sorted))

    return F.when(n >= 1, _bound(hashes, of_hashes)).otherwise(0)


def measures(text: Column) -> dict[str, Column]:
    """Expressions of all measures of a text (null: no words), each a long."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of_words(words: Column) -> Column:
        bare = lambda w: F.btrim(F.lower(w), F.lit(".,;:!?"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.array_contains(stops, bare(w)))).cast("long").alias("n_stop_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    return {
        "_words": _bound(_words(text), of_words),
        "_lines": _bound(lines, of_lines),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    }


_FROM = {
    "n_words": "_words", "word_chars": "_words", "n_repeat_words": "_words", "n_stop_words": "_words",
    "n_lines": "_lines", "n_dup_lines": "_lines",
}


def verdict(rules: tuple[Rule, ...], measured: Column) -> Column:
    """Whether the measures (a struct) pass all rules; ratios of a text without words or lines are 0."""
    passed = F.lit(True)
    for rule in rules:
        parts = [measured[p.strip()].cast("double") for p in rule.metric.split("/")]
        value = parts[0] if len(parts) == 1 else F.when(parts[1] > 0, parts[0] / parts[1]).otherwise(0.0)
        if rule.low is not None:
            passed = passed & (value >= rule.low)
        if rule.high is not None:
            passed = passed & (value <= rule.high)
    return passed


def measured(text: Column) -> Column:
    """One struct of all measures of a text."""
    found = F.struct(*[c.alias(n) for n, c in measures(text).items()])

    def flat(m: Column) -> Column:
        return F.struct(*[m[source][n].alias(n) for n, source in _FROM.items()], m["n_symbols"].alias("n_symbols"))

    return _bound(found, flat)


def quality_measures(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES
) -> DataFrame:
    """doc_id, all measures, base_failed and kept of every text.

    Words are runs without ASCII white space; lines are split at \\n and count if they have a word.
    base_failed: under 20 words, or over 30 % of them inside repeated windows. kept: not base_failed and
    all rules hold. Null and empty texts have no words and fail; repeated rows give a row each, an empty
    table none. Other columns are not carried, so their names cannot clash.
    """
    m = df.select(F.col(f"`{id_col}`").alias("doc_id"), measured(F.col(f"`{text_col}`")).alias("m"))
    failed = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    out = m.select("doc_id", "m.*", failed.alias("base_failed"), verdict(rules, F.col("m")).alias("kept"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("kept"))


def drop_low_quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The rows of df whose text passes all rules; all columns stay as they are, whatever their names.

    Null and empty texts have no words and fail the default rules; null ids are not looked at; equal rows fare alike; an empty
    table gives none. Texts of any length are measured whole.
    """
    return df.where(_bound(measured(F.col(f"`{text_col}`")), lambda m: verdict(rules, m)))


def oracle_sql(rules: tuple[Rule, ...] = DEFAULT_RULES) -> str:
    """DuckDB SQL of quality_measures over the table documents."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for rule in rules:
        parts = [p.strip() for p in rule.metric.split("/")]
        value = parts[0] if len(parts) == 1 else f"coalesce({parts[0]}::double / nullif({parts[1]}, 0), 0)"
        tests += [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return f"""
    WITH split AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    windows AS (
      SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
      FROM (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k
            FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM split WHERE len(w) >= 8))),
    covered AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM windows WHERE n > 1) GROUP BY r),
    measured AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([{stops}], trim(lower(x), '.,;:!?'))))::BIGINT AS n_stop_words,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
      FROM split LEFT JOIN covered c USING (r)),
    judged AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {' AND '.join(tests)} AS passed FROM measured)
    SELECT doc_id, n_words, word_chars, n_repeat_words, n_stop_words, n_lines, n_dup_lines, n_symbols, base_failed,
           NOT base_failed AND passed AS kept FROM judged"""
