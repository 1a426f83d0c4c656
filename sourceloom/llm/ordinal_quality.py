"""Graded quality by ordinal cumulative-link regression on hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds cut its line into grades:
P(grade <= k) = 1 / (1 + exp(-(threshold_k - score))). A text's score is the mean over its words of the weights of
six features of each word (the word, its shape, and its folded form with that one's first four, five and six letters), plus
weighted shares of repetition. The expected grade and the probability of the best grades (tail) serve for selection.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordMemory, cut_lineage, id_and_text, map_texts
from .toxicity import DIGITS, LOOKALIKES, SIGNS

#: Words in each generation of a worker's memory. Results do not depend on it.
MAX_WORDS = 200_000
#: Step of the fit, in parameters of features that are scaled alike.
RATE = 0.15
_RUNS = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{L}+"), "a"), (regex.compile(r"\p{N}+"), "9"), (regex.compile(r"([^Aa9])\1+"), r"\1\1"))


_FOLDS = str.maketrans(DIGITS | SIGNS | LOOKALIKES | {"1": "i", "l": "i"})


def folded(word: str) -> str:
    """A word in lower case, without the signs around it, with digits and signs as the letters that they stand for."""
    return word.lower().rstrip(".,;:!?*#%&$|()[]{}<>\"'").lstrip("*#%&|()[]{}<>\"'").translate(_FOLDS)


def word_features(word: str, n_features: int) -> tuple[int, ...]:
    shape, plain = word, folded(word)
    for pattern, to in _RUNS:
        shape = pattern.sub(to, shape)
    names = ("w" + word.lower(), "s" + shape[:12], "f" + plain, "4" + plain[:4], "5" + plain[:5], "6" + plain[:6])
    return tuple(xxhash.xxh64_intdigest(x) % n_features for x in names)


def text_features(text: str, words: list[str], n_features: int) -> tuple[tuple[int, float], ...]:
    """Shares of words that repeat the one before, of words that came up before and of lines that did."""
    n, lines = max(len(words), 1), text.split("\n")
    shares = {
        "rprevious": sum(map(operator.eq, words[1:], words)) / n,
        "rwords": 1 - len(set(words)) / n,
        "rlines": 1 - len(set(lines)) / len(lines),
    }
    return tuple((xxhash.xxh64_intdigest(name) % n_features, share) for name, share in shares.items())


@dataclass
class OrdinalModel:
    """weights over hashed features and ordered thresholds between the grades 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade from the label table: 0 poor, 1 good but toxic, 2 good; rows without id or labels are left out."""
    quality, toxic = F.col("quality").cast("int"), F.col("toxic").cast("int")
    grade = F.when(quality == 0, 0).when(toxic == 1, 1).when(toxic == 0, 2)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null")
    return known.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit_ordinal(
    docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_features: int = 1 << 15,
    most_rows: int = 6_000, rounds: int = 120, ridge: float = 4e-4,
) -> OrdinalModel:
    """Fits weights and thresholds to graded rows (doc_id, grade), none of them held out.

    At most most_rows rows are used, those of the smallest hashed ids, one for each id (the first of its texts in their order);
    their features (a few hundred numbers each as a rule, at most n_features) are fitted on the driver. Grades without a document and
    null ids are left out; null and empty texts have no words. Without rows, or with one grade only, all weights are 0.
    """
    pick = grades.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(pick), "doc_id")  # at most most_rows rows of two numbers
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def make():
        memory = WordMemory(lambda words: [word_features(w, n_features) for w in words], MAX_WORDS)

        def work(texts):
            split = [t.split() for t in texts]
            known, places, values = memory.table(split), [], []
            for text, words in zip(texts, split):
                ids = np.array([known[w] for w in words], np.int64).ravel()
                own, n = np.unique(ids, return_counts=True)
                more = text_features(text, words, n_features)
                places.append(np.concatenate([own, [k for k, _ in more]]).astype(np.int32))
                values.append(np.concatenate([n / max(len(words), 1), [x for _, x in more]]).astype(np.float32))
            return {"places": pa.array(places, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float32()))}

        return work

    table = cut_lineage(map_texts(rows, make, "places array<int>, values array<float>")).select("grade", "places", "values").toArrow().combine_chunks()
    grades = table["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(n_features), np.zeros(0))
    flat = lambda name: table[name].combine_chunks()
    ends = np.cumsum(flat("places").value_lengths().to_numpy())
    return _fit(grades, ends, flat("places").flatten().to_numpy(), flat("values").flatten().to_numpy(), n_features, int(grades.max()) + 1, rounds, ridge)


def _fit(y: np.ndarray, ends: np.ndarray, places: np.ndarray, values: np.ndarray, n_features: int, n_grades: int, rounds: int, ridge: float) -> OrdinalModel:
    """Full-batch Adam on the negative log-likelihood, with steps that shrink to nothing over the second half; later thresholds are sums of positive steps."""
    sizes = np.diff(ends, prepend=0)
    # rows in parts, so that what a step holds beside the data stays small
    parts = [(k, min(k + 500, len(y))) for k in range(0, len(y), 500)]
    spans = [slice(int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in parts]
    squares = sum(np.bincount(places[s], values[s].astype(float) ** 2, n_features) for s in spans)
    scale = 1 / np.sqrt(squares / len(y) + 1e-3)
    share = np.bincount(y, minlength=n_grades) / len(y)
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    parameters = np.concatenate([np.zeros(n_features), start[:1], steps])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, rounds + 1):
        w, cut, log_step = parameters[:n_features], parameters[n_features], parameters[n_features + 1 :]
        thresholds = np.concatenate([[-np.inf, cut], cut + np.cumsum(np.exp(log_step)), [np.inf]])
        scaled = scale * w
        score = np.concatenate([np.add.reduceat(values[s] * scaled[places[s]], ends[a:b] - sizes[a:b] - s.start) for (a, b), s in zip(parts, spans)])
        upper, lower = thresholds[y + 1] - score, thresholds[y] - score
        high, low = sigmoid(upper), sigmoid(lower)
        high, low = np.where(np.isposinf(upper), 1.0, high), np.where(np.isneginf(lower), 0.0, low)
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = -high * (1 - high) / p / len(y), low * (1 - low) / p / len(y)
        gradient = np.empty_like(parameters)
        pull = -(d_high + d_low)
        gradient[:n_features] = scale * sum(np.bincount(places[s], values[s] * np.repeat(pull[a:b], sizes[a:b]), n_features) for (a, b), s in zip(parts, spans)) + ridge * w
        by_cut = np.array([d_high[y == k].sum() + d_low[y == k + 1].sum() for k in range(n_grades - 1)])
        gradient[n_features] = by_cut.sum()
        gradient[n_features + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(log_step)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        parameters -= RATE * min(1.0, 2 * (1 - t / rounds)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    cut, log_step = parameters[n_features], parameters[n_features + 1 :]
    return OrdinalModel(parameters[:n_features] * scale, np.concatenate([[cut], cut + np.cumsum(np.exp(log_step))]))


def grade_scores(
    df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", tail_from: int | None = None, select_at: float = 0.5
) -> DataFrame:
    """doc_id, held_out, score, expected_grade, tail_probability (of grade tail_from, the best, or more) and selected.

    Null, empty and blank texts have no words: score 0, expected grade 0, tail 0, not selected. held_out is null for
    a null id. Repeated rows give a row each; an empty table gives none. Texts of any length are read whole.
    Other columns are not carried, so their names cannot clash.
    """
    weights, n_features = model.weights.astype(np.float64), len(model.weights)
    thresholds = [float(t) for t in model.thresholds]
    tail_from = len(thresholds) if tail_from is None else tail_from

    def make():
        memory = WordMemory(lambda words: [float(sum(weights[k] for k in word_features(w, n_features))) for w in words], MAX_WORDS)

        def work(texts):
            split = [t.split() for t in texts]
            value = memory.table(split).__getitem__

            def score(text, words):
                if not words:
                    return 0.0
                more = text_features(text, words, n_features)
                return sum(map(value, words)) / len(words) + sum(float(weights[k]) * x for k, x in more)

            return {
                "score": pa.array([score(*x) for x in zip(texts, split)], pa.float64()),
                "n_words": pa.array([len(words) for words in split], pa.int64()),
            }

        return work

    scored = map_texts(id_and_text(df, id_col, text_col), make, "score double, n_words long")
    above = [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in thresholds]  # P(grade > k)
    some = F.col("n_words") > 0
    expected = sum(above, F.lit(0.0))
    tail = above[tail_from - 1] if 0 < tail_from <= len(above) else F.lit(1.0)
    out = scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(some, expected).otherwise(0.0).alias("expected_grade"),
        F.when(some, tail).otherwise(0.0).alias("tail_probability"),
    )
    return out.withColumn("selected", F.col("tail_probability") >= select_at)
