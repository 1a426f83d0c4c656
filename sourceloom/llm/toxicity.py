"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps letters of other scripts that look like Latin ones, digits and signs that stand
for letters, drops invisible characters and turns what is no letter into single spaces. Matches inside an
exception phrase do not count. The sum of the weights of all matches is divided by the number of words; a
logistic curve over that density gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, map_texts, text_blocks

#: Bytes of texts whose patterns are held together; a word has a pattern for itself and one for each length of a beginning.
PATTERN_BYTES = 100_000

#: Signs that stand for letters, and letters of other scripts that look like them.
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝкмтвнгαβεικνορτυχω", "aceopxyijshdqwkmtbhrabeiknoptuxw"))

_LETTER, _SIGN, _DROP = 1, 2, 4
_BLANK = 0x20


@lru_cache(maxsize=1)
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point what it folds to, and whether that is a letter, a sign or nothing."""
    to, kind = np.full(0x110000, _BLANK, np.uint32), np.zeros(0x110000, np.uint8)
    for point in [*range(0xD800), *range(0xE000, 0x20000)]:
        char = chr(point)
        category = unicodedata.category(char)
        if category == "Cf" or char == "­":
            kind[point] = _DROP
        elif category[0] == "L" or char in DIGITS:
            low = char.lower()
            if point > 0x2000 or char in "ſ":
                low = unicodedata.normalize("NFKC", char).lower()
            low = low if len(low) == 1 else char
            low = DIGITS.get(low, LOOKALIKES.get(low, low))
            to[point], kind[point] = ord("i" if low == "l" else low), _LETTER
        elif category == "Nd":
            digit = str(unicodedata.digit(char, 0))
            to[point], kind[point] = ord(DIGITS.get(digit, digit)), _LETTER
        elif category[0] == "M":
            to[point], kind[point] = point, _LETTER
        elif char in SIGNS:
            to[point], kind[point] = ord(SIGNS[char]), _SIGN
    return to, kind


def fold(text: str) -> str:
    """Folded words with one space before, between and after them; l, 1 and i are one letter."""
    if not text:
        return " "
    to, kind = fold_tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[points]
    if (kinds == _DROP).any():
        points = points[kinds != _DROP]
        kinds = kinds[kinds != _DROP]
    letter = kinds == _LETTER
    inside = np.zeros(len(points), bool)  # signs count as letters only before a letter
    inside[:-1] = letter[1:] & (kinds[:-1] == _SIGN)
    out = np.where(letter | inside, to[points], _BLANK).astype(np.uint32)
    blank = out == _BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return " " + out[keep].tobytes().decode("utf-32-le", "surrogatepass").strip() + " "


def features(folded: str, prefixes: tuple[int, ...]) -> set[str]:
    """Patterns that a text matches: " word " and " prefix" of the given lengths."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in prefixes:
        found.update(" " + w[:n] for w in words if len(w) > n)
    return found


@dataclass
class ToxicityModel:
    """weights: patterns to weights; exceptions: folded phrases; score = 1 / (1 + exp(-(bias + slope x)))."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -20.0
    slope: float = 0.0

    def score(self, total: float, n_words: int) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + self.slope * density(total, n_words)))))


def density(total: float, n_words: int) -> float:
    """Weight per hundred words, on a logarithmic scale."""
    return math.log1p(100 * total / max(n_words, 1))


class Matcher:
    """Finds the patterns of a model in a folded text."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.automaton = None
        if model.weights:
            self.automaton = ahocorasick.Automaton()
            for pattern, weight in model.weights.items():
                self.automaton.add_word(pattern, (len(pattern), weight))
            for phrase in model.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None))
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the heaviest match at every place where a word begins, exceptions left out."""
        found: dict[int, float] = {}
        if self.automaton is None:
            return found
        spared = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return found

    def sums(self, text: str) -> tuple[float, int]:
        folded = fold(text)
        return sum(self.hits(folded).values()), max(0, folded.count(" ") - 1)


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_toxic: int, most_clean: int
) -> DataFrame:
    """A bounded sample of labelled rows that are not held out: toxic, text.

    Of rows of one id the first text in their order is taken, so the bounds on ids bound the rows.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = known.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(most_clean)
    )
    # at most most_toxic + most_clean rows of two numbers
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return cut_lineage(rows.select("toxic", "text"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = 3_000,
    most_clean: int = 9_000, least_share: float = 0.01, prefixes: tuple[int, ...] = (4, 5, 6, 7, 8),
    exceptions: tuple[str, ...] = (),
) -> ToxicityModel:
    """Learns the lexicon, its weights, exception phrases and the curve from labelled rows.

    At most most_toxic and most_clean rows are used, those of the smallest hashed ids, and none that is held
    out (crc32 of the id as text divisible by 5), one for each id. A pattern is a whole word or the beginning of one; it must
    stand in least_share of the toxic texts and in five, copies counted once (texts whose smallest hashed 3-word shingle
    is the same), and be at least ten times as frequent among toxic texts as among others. Given exceptions
    are phrases; others are learned: phrases of two words around a match that only clean texts have.
    Nothing else is cut: all such patterns and phrases are kept, of words of any length. As each pattern takes least_share of
    the toxic texts, the driver gets at most 1 / least_share times the patterns of an average one. Null ids and labels are left
    out, null and empty texts have no words. Without toxic or clean rows, or without such patterns, the lexicon is empty and all
    scores are near 0; a text without matches always scores under 0.5.
    """
    rows = training_rows(docs, labels, id_col, text_col, most_toxic, most_clean)
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    given = tuple(fold(x) for x in exceptions)
    if not n_toxic or not n_clean:
        return ToxicityModel(exceptions=given)
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")

    def with_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch.column("text"), PATTERN_BYTES):
                pairs = set()
                for text in part.to_pylist():
                    folded = fold(text)
                    words = folded.split()
                    kin = min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2)))
                    pairs.update((pattern, kin >> 1) for pattern in features(folded, prefixes))
                columns = list(zip(*pairs)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["pattern", "kin"])

    found = toxic.select("text").mapInArrow(with_copies, "pattern string, kin long").distinct().groupBy("pattern").count()
    least = max(5, math.ceil(least_share * n_toxic))
    candidates = {r["pattern"]: r["count"] for r in found.where(F.col("count") >= least).collect()}

    def of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in text_blocks(batch.column("text")):
                for text in part.to_pylist():
                    seen.update(candidates.keys() & features(fold(text), prefixes))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    among_clean = {
        r["pattern"]: r["n"]
        for r in clean.select("text").mapInArrow(of_candidates, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    }
    weights: dict[str, float] = {}
    for pattern, n in sorted(candidates.items(), key=lambda x: (len(x[0].rstrip()), -x[1], x[0])):
        weight = math.log(((n + 0.5) / (n_toxic + 1)) / ((among_clean.get(pattern, 0) + 0.5) / (n_clean + 1)))
        shorter = any(pattern[:k] in weights for k in range(2, len(pattern)))
        if weight >= math.log(10) and not shorter:
            weights[pattern] = weight

    model = ToxicityModel(weights, given)
    if not weights:  # nothing tells toxic texts: none is called toxic
        return model
    model.exceptions = (*given, *_learn_exceptions(rows, model))
    model.bias, model.slope = _fit_curve(_sums(rows, model).select("toxic", "total", "n_words").collect())
    return model


def _sums(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    def make():
        matcher = Matcher(model)

        def work(texts):
            found = [matcher.sums(t) for t in texts]
            return {"total": pa.array([x for x, _ in found], pa.float64()), "n_words": pa.array([n for _, n in found], pa.int64())}

        return work

    return map_texts(rows, make, "total double, n_words long")


def _learn_exceptions(rows: DataFrame, model: ToxicityModel, least: int = 3) -> list[str]:
    """Phrases of two words around a match that stand in at least so many clean texts and in no toxic one."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(model), Counter()
        for batch in batches:
            labels = iter(batch.column("toxic").to_pylist())
            for part in text_blocks(batch.column("text")):
                for text, toxic in zip(part.to_pylist(), labels):
                    folded, own = fold(text), set()
                    for start in matcher.hits(folded):
                        stop = folded.index(" ", start + 1)
                        before = folded.rfind(" ", 0, start)
                        after = folded.find(" ", stop + 1)
                        own.update({folded[before : stop + 1]} if before >= 0 else ())
                        own.update({folded[start : after + 1]} if after >= 0 else ())
                    seen.update((toxic, phrase) for phrase in own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["toxic", "phrase", "n"],
        )

    found = rows.mapInArrow(phrases, "toxic int, phrase string, n long").groupBy("phrase").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("clean")
    )
    found = found.where((F.col("toxic") == 0) & (F.col("clean") >= least))
    return sorted(r["phrase"] for r in found.collect())


def _fit_curve(rows: list, ridge: float = 0.02, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope of a logistic curve over density, with both classes weighted alike and a small ridge."""
    x = np.array([density(r["total"], r["n_words"]) for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        penalty = ridge * np.array([0.0, 1.0]) * 0.1
        gradient = design.T @ (weight * (p - y)) + penalty * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(min(beta[0], -0.5)), float(max(beta[1], 0.0))  # a text without matches is never called toxic


def toxicity_scores(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) and n_words of every text.

    Null and empty texts have no match and the score of density 0. held_out is null for a null id.
    Repeated rows give a row each; an empty table gives none. Texts of any length are matched whole. Other
    columns are not carried, so their names cannot clash.
    """

    sums = _sums(id_and_text(df, id_col, text_col), model)
    x = F.log1p(F.lit(100.0) * F.col("total") / F.greatest(F.col("n_words"), F.lit(1)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(model.bias) + F.lit(model.slope) * x))))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return sums.select("doc_id", held_out.alias("held_out"), score.alias("score"), "n_words").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words"
    )


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df without the rows whose text scores `threshold` or more; all columns stay as they are, whatever their names.

    Null and empty texts have no match and stay, and so do rows of null ids; equal rows fare alike; an empty table gives none.
    Texts of any length are matched whole.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            begin = 0
            for part in text_blocks(batch.column(at)):
                kept = [model.score(*matcher.sums(text or "")) < threshold for text in part.to_pylist()]
                yield batch.slice(begin, len(kept)).filter(pa.array(kept, pa.bool_()))
                begin += len(kept)

    return df.mapInArrow(run, df.schema)
