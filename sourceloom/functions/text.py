"""Lines, comments, sentences and model answers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

#: White space as str.strip of ASCII text has it.
BLANKS = " \t\n\r\x0b\x0c"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def lines_of(text: Column) -> Column:
    return F.split(unix_lines(text), "\n", -1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def explode_lines(df: DataFrame, text: Column, first: Column) -> DataFrame:
    """Adds line (its real number) and numbered (the number right-aligned before the line) per line of text."""
    lines = lines_of(text)
    width = F.length((first + F.size(lines) - 1).cast("string"))
    rows = df.select("*", width.alias("_width"), first.alias("_first"), F.posexplode(lines).alias("_k", "_line"))
    number = F.col("_first") + F.col("_k")
    numbered = F.concat(F.lpad(number.cast("string"), F.col("_width"), F.lit(" ")), F.lit(" | "), F.col("_line"))
    return rows.select(*df.columns, number.cast("long").alias("line"), numbered.alias("numbered"))


def line_count(text: Column) -> Column:
    """Newlines and one more, but no line after a last newline; an empty text has one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1 - F.endswith(text, F.lit("\n")).cast("int")).cast("long")


def strip_python_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"#[^\n]*", "")


def strip_cpp_comments(text: Column) -> Column:
    """Block comments become as many newlines as they held; then line comments go."""
    block = r"(?s)/\*.*?\*/"
    between = F.split(text, block, -1)
    inside = F.array_append(F.regexp_extract_all(text, F.lit(f"({block})"), 1), F.lit(""))
    kept = F.array_join(F.zip_with(between, inside, lambda a, b: F.concat(a, F.regexp_replace(b, r"[^\n]+", ""))), "")
    return F.regexp_replace(kept, r"//[^\n]*", "")


def strip_comments(text: Column, language: Column) -> Column:
    return F.when(language == "Python", strip_python_comments(text)).otherwise(strip_cpp_comments(text))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))


def shorten(text: Column, most: int = rules.HINT_CHARS) -> Column:
    return let(collapse(text), lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t))


def fit_excerpt(text: Column, most: Column | int) -> Column:
    """Without outer newlines; longer text is cut at the last line end that fits, or hard where there is none."""
    most = F.lit(most) if isinstance(most, int) else most

    def cut(t: Column) -> Column:
        head = F.substring(t, F.lit(1), most)
        back = F.instr(F.reverse(head), "\n")
        at = most - back
        return F.when(F.length(t) <= most, t).when((back > 0) & (at > 0), F.substring(t, F.lit(1), at)).otherwise(head)

    return let(F.btrim(unix_lines(text), F.lit("\n")), cut)


def sentences(text: Column) -> Column:
    """Parts that end with . ! or ? before white space."""
    return F.split(strip(text), r"(?<=[.!?])[ \t\n\r\x0B\f]+")


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def _mask_code(text: Column) -> Column:
    """Marks between backticks no longer look like ends of sentences."""
    return F.array_join(F.transform(F.split(text, "`", -1), lambda p, k: F.when(k % 2 == 1, F.translate(p, ".!?", "___")).otherwise(p)), "`")


def tidy_answer(text: Column) -> Column:
    """Text of 100 characters that ends unfinished goes back to its last sentence or word; repeated sentences go."""
    ticks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("`"), F.lit("")))) % 2

    def finish(t: Column) -> Column:
        whole = F.length(F.regexp_extract(_mask_code(t), r"(?s)^(.*[.!?])(?:\s.*)?$", 1))
        open_tick = F.when(ticks(t) == 1, F.regexp_replace(t, r"(?s)`[^`]*$", "")).otherwise(t)
        words = F.rtrim(F.regexp_replace(open_tick, r"(?s) [^ ]*$", ""), F.lit(" ,;:(-"))
        cut = F.when(whole > 0, F.substring(t, F.lit(1), whole)).otherwise(F.concat(words, F.lit("...")))
        unfinished = (F.length(t) >= rules.CUT_OFF_CHARS) & (~F.right(t, F.lit(1)).isin(".", "!", "?") | (ticks(t) == 1))
        return F.when(unfinished, cut).otherwise(t)

    return F.array_join(F.array_distinct(F.split(let(strip(text), finish), r"(?<=[.!?])[ \t\n\r\x0B\f]+", -1)), " ")


def finish_cut_off(text: Column) -> Column:
    """A text that ends in ... is cut back to its last clause of at least 20 characters and gets a full stop."""
    body = F.regexp_replace(text, r"(?s)\.\.\.$", "")
    clause = F.regexp_extract(body, r"(?s)^(.*)[,;:][^,;:]*$", 1)
    known = F.endswith(text, F.lit("...")) & F.regexp_like(body, F.lit("[,;:]")) & (F.length(clause) >= rules.ANSWER_CHARS)
    return F.when(known, F.concat(F.rtrim(clause, F.lit(BLANKS)), F.lit("."))).otherwise(text)


#: Small letters whose full capital is several letters but that have a capital of one letter as well.
_SMALL = "ß" + "".join(chr(c + k) for c in (0x1F80, 0x1F90, 0x1FA0) for k in range(8)) + "ᾳῃῳ"
_CAPITAL = "ẞ" + "".join(chr(c + k) for c in (0x1F88, 0x1F98, 0x1FA8) for k in range(8)) + "ᾼῌῼ"


def capital(letter: Column) -> Column:
    """A letter's capital that is one letter, too: ẞ for ß, and a ligature or a letter without such a capital stays as it is."""
    return let(F.upper(letter), lambda u: F.when(F.length(u) > 1, F.translate(letter, _SMALL, _CAPITAL)).otherwise(u))


def strip_subject(text: Column, subject: str = rules.SUBJECT_PATTERN, fragment: str = rules.FRAGMENT_PATTERN) -> Column:
    """Without a start that only names the function, unless little or a fragment would be left."""

    def body(rest: Column) -> Column:
        useless = (F.length(rest) < rules.ANSWER_CHARS) | F.regexp_like(rest, F.lit("(?i)" + fragment))
        return F.when(useless, text).otherwise(F.concat(capital(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))

    return let(F.regexp_replace(text, "(?i)" + subject, ""), body)


def word_runs(text: Column, n: int = rules.COPY_WORDS) -> Column:
    """All runs of n words of a text, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), 1)

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda k: F.array_join(F.slice(w, k, n), " ")))

    return let(words, runs)


def clean_answer(raw: Column, instruction: Column, n_sentences: int) -> Column:
    """The first line, tidied and cut to whole sentences; empty if under 20 characters or copied from the instruction."""
    line = F.element_at(F.split(strip(raw), "\n", -1), 1)

    def judge(t: Column) -> Column:
        copied = F.arrays_overlap(word_runs(t), word_runs(instruction))
        return F.when((F.length(t) < rules.ANSWER_CHARS) | F.coalesce(copied, F.lit(False)), F.lit("")).otherwise(t)

    return let(first_sentences(finish_cut_off(tidy_answer(line)), n_sentences), judge)


def join_clauses(items: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def list_names(items: Column, most: int = 8) -> Column:
    """The first names and how many more there are."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)


def duration(seconds: Column) -> Column:
    """Whole minutes from 120 seconds on."""
    return F.when(seconds >= 120, F.format_string("%d minute", F.bround(seconds / 60).cast("long"))).otherwise(
        F.format_string("%d second", F.bround(seconds).cast("long"))
    )


def chunk_text(path: Column, language: Column, kind: Column, name: Column, source: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit("\nLanguage: "), language, F.lit("\nType: "), kind, F.lit("\nName: "), name, F.lit("\n\n"), source)


def outside_data(name: Column, stems: tuple[str, ...] = rules.OUTSIDE_DATA_STEMS) -> Column:
    """Whether a word of a name starts like one for data from outside."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    return F.exists(words, lambda w: F.regexp_like(w, F.lit("^(?:" + "|".join(stems) + ")")))


def branch_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(r"\b(" + "|".join(rules.BRANCH_WORDS) + r")\b")).cast("long")


def branch_points(count: Column) -> Column:
    return F.when(count >= rules.MANY_BRANCHES, 2).when(count >= rules.SOME_BRANCHES, 1).otherwise(0)


def may_recurse(code: Column, short_name: Column) -> Column:
    """A name that is followed by a parenthesis twice or more."""
    found = F.regexp_count(code, F.concat(F.lit(r"\b\Q"), short_name, F.lit(r"\E\s*\(")))
    return (F.length(short_name) > 0) & (found >= 2)


def chunk_name(raw: Column) -> Column:
    """A qualified name without its first scope: A::f gives f, a::b::f gives b::f."""
    return F.regexp_replace(raw, r"^[^:]*::", "")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "::", -1), -1)
