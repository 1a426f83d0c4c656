"""Bounded-space online packing of documents into token sequences.

A task reads its documents in order and keeps a fixed number of open windows. A piece goes to the fullest
window that it fits into; where none fits, the fullest is emitted and a new one opened. A document longer
than a window is cut into whole windows and a rest. The windows that are still open at the end of a task are
pieces of a next, much smaller packing over groups of tasks, until one group is left.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemory, blocks, cut_lineage, id_and_text, text_blocks, tokenizer_path

#: Words in each generation of a worker's memory. Results do not depend on it.
MAX_WORDS = 500_000
#: Words that the library gets in one call.
LINE = 256
#: Tasks, or groups of them, whose open windows are merged together.
FAN_IN = 64

#: ASCII signs between a Latin letter and white space are a piece of their own; a space before them changes no ids.
#: Not after U+0130, whose lower case ends in a mark, nor after other scripts, whose normal forms can.
_SIGNS = re.compile(r"[!-&(-/:-@\[-^`{-~](?<=[A-Za-zÀ-ÖØ-öø-įı-ɏ][!-&(-/:-@\[-^`{-~])[!-&(-/:-@\[-^`{-~]*(?=\s)")
_SPACES = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


class WordTokenizer:
    """Ids of texts by the tokenizers library, which encodes each word between white space once.

    It must drop white space and split there, so that a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = WordMemory(self._learn, MAX_WORDS)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words are encoded in lines of LINE words, and offsets tell whose an id is."""
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        out = []
        for line, found in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)):
            ends = np.cumsum([len(word) + 1 for word in line])
            owner = np.searchsorted(ends, [start for start, _ in found.offsets], side="right")
            cuts = np.searchsorted(owner, np.arange(len(line) + 1)).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            out.extend(ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:]))
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space for Python only
            return [w for w in _SPACES.split(text) if w]
        return (text if "<|" in text else _SIGNS.sub(r" \g<0>", text)).split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for a, b in blocks(texts, 3_000_000):
            split = [self.words(text) for text in texts[a:b]]
            ids_of = self.memory.table(split).__getitem__
            for words in split:
                yield b"".join(map(ids_of, words))


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class OpenWindows:
    """A bounded set of open windows, ordered by how full they are."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.fills: list[int] = []
        self.windows: list[list] = []

    def place(self, item, length: int) -> list:
        """Put an item into a window; gives the items (item, offset) of a window that had to go, if any."""
        at = bisect_right(self.fills, self.capacity - length) - 1
        gone: list = []
        if at >= 0:
            fill, window = self.fills.pop(at), self.windows.pop(at)
        else:
            if len(self.fills) >= self.most:
                self.fills.pop()
                gone = self.windows.pop()
            fill, window = 0, []
        window.append((item, fill))
        fill += length
        if fill == self.capacity and not gone:
            return window
        at = bisect_left(self.fills, fill)
        self.fills.insert(at, fill)
        self.windows.insert(at, window)
        return gone


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_open boolean"
)


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, most_open: int, with_ids: bool) -> DataFrame:
    names = [part.split()[0] for part in _PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.bool_()] + [pa.list_(pa.int32())] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n_windows = TaskContext.get().partitionId() << 32, 0
        tokenizer, open_windows, rows = load_tokenizer(path), OpenWindows(capacity, most_open), []

        def emit(window: list, is_open: bool) -> None:
            nonlocal n_windows
            for (doc_id, start, n, crc, total, ids), offset in window:
                row = (doc_id, start, n, crc, total, first + n_windows, offset, is_open)
                rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
            n_windows += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            out = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            doc_ids = iter(batch.column(batch.schema.get_field_index("doc_id")).to_pylist())
            texts = text_blocks(batch.column(batch.schema.get_field_index("text")))
            for ids, doc_id in zip((ids for part in texts for ids in tokenizer.encode(part.to_pylist())), doc_ids):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    gone = open_windows.place((doc_id, start, n, zlib.crc32(part), total, part if with_ids else None), n)
                    if gone:
                        emit(gone, False)
                if len(rows) >= 5_000:
                    yield flush()
        tokenizer.memory.forget()
        for window in open_windows.windows:
            emit(window, True)
        yield flush()

    return docs.mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def _merger(base: int, last: bool, capacity: int, most_open: int):
    """Packs the open windows of one group of tasks, fullest first.

    A group leaves most_open windows open at most, of more the fullest are final, so groups of every level hold FAN_IN times
    most_open at most. At the last level all are placed and closed.
    """

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "sequence_id"], ascending=[False, True])
        windows, n, out = OpenWindows(capacity, len(group) if last else most_open), 0, []
        number = base + (int(group["to_place"].iloc[0]) << 32)

        def emit(window, is_open):
            nonlocal n
            fill = sum(f for (_, f), _ in window)
            out.extend((s, number + n, shift, fill, is_open) for (s, _), shift in window)
            n += 1

        for s, f in zip(group["sequence_id"].tolist(), group["fill"].tolist()):
            gone = windows.place((s, f), f)
            if gone:
                emit(gone, False)
        for window in windows.windows:
            emit(window, not last)
        return pd.DataFrame(out, columns=["from_id", "to_id", "shift", "fill", "is_open"])

    return merge


def _merge_open(pieces: DataFrame, n_parts: int, capacity: int, most_open: int) -> DataFrame:
    """from_id, to_id and shift of every window that was left open."""
    waiting = (
        pieces.where("is_open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        .select("sequence_id", "fill", F.expr("cast(shiftright(sequence_id, 32) as bigint)").alias("place"))
    )
    level, moved = 1, None
    while True:
        n_parts, last = -(-n_parts // FAN_IN), n_parts <= FAN_IN
        grouped = waiting.withColumn("to_place", F.floor(F.col("place") / FAN_IN).cast("long"))
        placed = cut_lineage(
            grouped.groupBy("to_place").applyInPandas(_merger(level << 56, last, capacity, most_open), "from_id long, to_id long, shift long, fill long, is_open boolean")
        )
        step = placed.select("from_id", "to_id", "shift")
        if moved is None:
            moved = step
        else:
            then = step.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next_id"), F.col("shift").alias("more"))
            moved = moved.join(then, "to_id", "left").select(
                "from_id", F.coalesce("next_id", "to_id").alias("to_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        if last:
            return moved
        waiting = placed.where("is_open").groupBy("to_id").agg(F.first("fill").alias("fill")).select(
            F.col("to_id").alias("sequence_id"), "fill", F.expr("cast(shiftright(to_id, 32) & 16777215 as bigint)").alias("place")
        )
        level += 1


def pack_sequences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 4096,
    end_id: int = 2, most_open: int = 128, with_ids: bool = True,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids.

    Every document's ids, closed by end_id, lie in exactly one piece each; offsets within a sequence have
    no gaps; sequences hold at most `capacity` ids. Null text counts as empty: one piece with end_id. A null
    id stays null; repeated rows are packed once each; an empty table gives no rows. Other columns are not
    carried, so their names cannot clash. with_ids=False leaves the ids out and keeps only their checksum.
    """
    docs = id_and_text(df, id_col, text_col)
    pieces = cut_lineage(_pieces(docs, tokenizer_path(tokenizer), capacity, end_id, most_open, with_ids))
    moved = _merge_open(pieces, max(1, pieces.rdd.getNumPartitions()), capacity, most_open)
    joined = pieces.join(moved, F.col("sequence_id") == F.col("from_id"), "left")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("to_id", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *["ids"] * with_ids,
    )


def assemble_sequences(pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids and ids (padded to capacity) of every sequence; a group holds at most capacity ids.

    Pieces of null ids and of empty texts (their end id alone) count like others, so do pieces of repeated rows, and a long text's
    pieces stand in several sequences; offsets leave no ties. An empty table gives no rows. Other columns of pieces are left out.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    rows = pieces.groupBy("sequence_id").agg(ids.alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))
    return rows.select("sequence_id", n.cast("long").alias("n_ids"), padded.alias("ids"))
