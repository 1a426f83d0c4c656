"""Small helpers that several corpus operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers

from ..scratch import cut_lineage  # noqa: F401

#: Code points that are handled together in one vectorised step.
BLOCK_CHARS = 1_000_000


def tokenizer_path(path_or_name: str) -> str:
    """A full path stays; a bare name is looked up among the public tokenizers."""
    return path_or_name if "/" in path_or_name else public_tokenizers.path(path_or_name)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs, as doc_id (a long: ids of other types must be castable) and text (null: empty)."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` code points together; a longer text is alone."""
    begin = size = 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], fields: str
) -> DataFrame:
    """Run make()(texts) over blocks of rows in the tasks; all columns but text are passed through.

    fields is DDL of the columns that the function returns in addition.
    """
    kept = [field for field in df.schema if field.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])
    names = [part.split()[0] for part in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            others = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            sizes = np.diff(np.asarray(_offsets(column)))
            for a, b in _byte_blocks(sizes):
                texts = column.slice(a, b - a).to_pylist()
                out = work(texts)
                columns = [*(c.slice(a, b - a) for c in others), *(_array(out[n]) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *names])

    return df.mapInArrow(run, schema)


def text_blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[pa.Array]:
    """Slices of a column of texts, each of bounded bytes or one text."""
    for a, b in _byte_blocks(np.diff(np.asarray(_offsets(column))), limit):
        yield column.slice(a, b - a)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, width)


def _byte_blocks(sizes: np.ndarray, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def pack_table(table: np.ndarray) -> bytes:
    """A table of fixed size in a form that travels well inside a closure."""
    return zlib.compress(table.tobytes(), 1)


def unpack_table(packed: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=dtype)


class WordMemory:
    """What a worker has found out about words, in two generations of bounded size.

    learn(words) must give the values of a list of unknown words. Words that come up again move to the
    young generation, so frequent ones stay when the old generation is given up.
    """

    def __init__(self, learn: Callable[[list[str]], list], limit: int):
        self.learn, self.limit = learn, limit
        self.forget()

    def forget(self) -> None:
        """Both generations are given up: workers outlive their task, and other stages need the room."""
        self.young: dict = {}
        self.old: dict = {}

    def table(self, groups: list[list[str]]) -> dict:
        """A dictionary that holds every word of the groups."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        words = set().union(*groups)
        words.difference_update(self.young)
        fresh = []
        for word in words:
            value = self.old.get(word)
            if value is None:
                fresh.append(word)
            else:
                self.young[word] = value
        self.young.update(zip(fresh, self.learn(fresh)))
        return self.young
