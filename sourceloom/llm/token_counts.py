"""Token counts by a compiled finite-state tokenizer, without building the tokens.

Two deterministic transducers run in cascade. The first marks pre-token borders (see pretokens): its
state maps of fixed chunks compose through a parallel prefix scan. The second reads the bytes of one
pre-token from its reset state and annotates every transition with the number of tokens that it adds to
the byte-pair encoding of the prefix read so far (the number can be negative: a merge undoes tokens).
A border resets the second machine whatever its state was, so of a chunk's map over both machines nothing but
the border state and a number of tokens can reach the next chunk at a border: the states are scanned first, and the
counts by a second prefix scan, of sums. A text's count is the difference of what was emitted at its two ends.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import WordMemory, id_and_text, map_texts, tokenizer_path

#: Bounds on what a worker keeps, in entries. Results do not depend on them.
MAX_STATES = 150_000
MAX_PAIRS = 500_000
MAX_WORDS = 200_000


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class CountTransducer:
    """Reads bytes of a pre-token; transitions are compiled when first taken.

    A state is the set of places from which a vocabulary token may still be under way: for each, the
    node of the vocabulary's trie, the last token of the encoding that ends there, and that encoding's
    length relative to the newest place. A token can follow another exactly if no merge would join
    them across their border, and for every prefix exactly one token can come last.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        ids = {bytes([b]): b for b in range(256)}
        self.rank, self.parts = {}, [None] * 256
        for k, (a, b) in enumerate(merges):
            left, right = ids[a], ids[b]
            self.rank.setdefault((left, right), k)
            if a + b not in ids:
                ids[a + b] = len(self.parts)
                self.parts.append((left, right, k))
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, name in ids.items():
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.children.append({})
            self.token_at[node] = name
        self.follows: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.sets, self.moves = {}, [], {}
        self.start = self._state(((0, -1, 0),))

    def _state(self, places: tuple) -> int:
        known = self.states.get(places)
        if known is None:
            known = self.states[places] = len(self.sets)
            self.sets.append(places)
        return known

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their bytes are encoded together.

        The tokens at the border are undone from the latest merge backwards. A pair that stands there
        for a while is joined if its merge comes before those that absorb its two members; of equal
        merges the left one comes first.
        """
        never = 1 << 60
        x, y, x_ends, y_ends, fits = a, b, never, never, True
        while True:
            merge = self.rank.get((x, y))
            if merge is not None and merge < x_ends and merge <= y_ends:
                fits = False
                break
            from_x, from_y = self.parts[x], self.parts[y]
            if from_x is None and from_y is None:
                break
            if from_y is None or from_x is not None and from_x[2] > from_y[2]:
                x, x_ends = from_x[1], from_x[2]
            else:
                y, y_ends = from_y[0], from_y[2]
        if len(self.follows) > MAX_PAIRS:
            self.follows.clear()
        self.follows[a << 32 | b] = fits
        return fits

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        children, token_at, follows = self.children, self.token_at, self.follows
        ahead, last, count = [], -1, 0
        for node, before, n in self.sets[state]:
            then = children[node].get(byte)
            if then is None:
                continue
            if last < 0:
                token = token_at[then]
                if token >= 0:
                    fits = before < 0
                    if not fits:
                        fits = follows.get(before << 32 | token)
                        if fits is None:
                            fits = self._can_follow(before, token)
                    if fits:
                        last, count = token, n + 1
            if children[then]:  # else no longer token can come from there
                ahead.append((then, before, n))
        places = (*[(then, before, n - count) for then, before, n in ahead], (0, last, 0))
        move = self.moves[state << 8 | byte] = (self._state(places), count)
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.sets) > MAX_STATES:
            self.reset()
        state, total, moves = self.start, 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
                if len(self.sets) > 4 * MAX_STATES:  # one very long pre-token
                    places = self.sets[move[0]]
                    self.reset()
                    moves, move = self.moves, (self._state(places), move[1])
            state, more = move
            total += more
        return total


@lru_cache(maxsize=2)
def load_transducer(path: str) -> tuple[CountTransducer, tuple[str, ...], WordMemory]:
    """The transducer of a byte-level tokenizer file, its added tokens, and a memory of words' counts."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kind = spec["pre_tokenizer"]
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"]:
        raise ValueError(f"{path}: a byte-level BPE file without normalizer and prefix space is needed")
    symbol = byte_symbols()
    read = lambda token: bytes(symbol[x] for x in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    added = tuple(sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))
    machine = CountTransducer([(read(a), read(b)) for a, b in pairs])
    learn = lambda words: [machine.count(word.encode("utf-8")) for word in words]
    return machine, added, WordMemory(learn, MAX_WORDS)


def counter(path: str, packed_classes: bytes):
    """A function from texts to their numbers of tokens."""
    _, added, memory = load_transducer(path)
    table = pretokens.unpacked(packed_classes)

    def count(texts: list[str]) -> list[int]:
        parts, of, totals = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for token in added:
                if token in text:
                    pieces = [q for p in pieces for q in p.split(token)]
                    totals[k] += text.count(token)
            parts += pieces
            of += [k] * len(pieces)
        split, ends = pretokens.split_flat(parts, table)
        tokens_of = memory.table([split]).__getitem__
        # what the machine has emitted by the end of each part: the counts' half of the scan, sums that compose like the state maps
        emitted = np.concatenate([[0], np.cumsum(np.fromiter(map(tokens_of, split), np.int64, len(split)))])[ends]
        np.add.at(totals, of, np.diff(emitted, prepend=0))
        return totals.tolist()

    return count


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    The counts are those of the tokenizers library with its defaults and without added special tokens.
    Null text counts as empty (0 bytes, 0 tokens); a null id stays null. Repeated rows and ties give a row
    each, an empty table gives none. Texts of any length are read whole. Other columns are not carried, so
    their names cannot clash.
    """
    path = tokenizer_path(tokenizer)
    packed = pretokens.tokenizers_classes()

    def make():
        count = counter(path, packed)
        return lambda texts: {"n_tokens": count(texts), "n_bytes": [len(t.encode("utf-8")) for t in texts]}

    out = map_texts(id_and_text(df, id_col, text_col), make, "n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
