"""Byte-level BPE by ranks: encoding and decoding of whole texts.

Whole pre-tokens that are vocabulary entries are found by a minimal perfect hash over the vocabulary
(hash and displace: one displacement per small bucket of keys, as many slots as keys; the key kept in
the slot confirms a hit). The others are merged with a heap of candidate pairs over a linked list of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import pretokens
from .common import WordMemory, id_and_text, map_texts, tokenizer_path

#: Words in each generation of a worker's memory. Results do not depend on it.
MAX_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in slots 0 to n-1, without gaps."""

    BUCKET = 4  # keys per bucket on average

    def __init__(self, keys: list[bytes]):
        self.n, self.n_buckets = len(keys), len(keys) // self.BUCKET + 1
        hashes = self.hashes(keys)
        buckets = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        bounds = np.searchsorted(buckets[order], np.arange(self.n_buckets + 1))
        self.shift = np.zeros(self.n_buckets, np.uint64)
        taken, self.keys, self.slot_of = np.zeros(self.n, bool), [b""] * self.n, {}
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[bounds[b] : bounds[b + 1]]
            if not len(mine):
                break
            base = 0
            while True:  # the first displacement that sends the whole bucket to free, distinct slots
                tries = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slots(hashes[mine][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if len(mine) > 1:
                    free &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    break
                base += 256
            self.shift[b] = tries[k]
            taken[slots[k]] = True
            for key, slot in zip(mine.tolist(), slots[k].tolist()):
                self.keys[slot] = keys[key]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (hashes ^ (shift + np.uint64(1)) * _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Slot of every key, -1 where it is none of the vocabulary's."""
        if not keys:
            return np.zeros(0, np.int64)
        hashes = self.hashes(keys)
        slots = self._slots(hashes, self.shift[(hashes % np.uint64(self.n_buckets)).astype(np.int64)])
        mine = self.keys
        return np.fromiter((s if mine[s] == key else -1 for s, key in zip(slots.tolist(), keys)), np.int64, len(keys))


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # end[k]: where the part that begins at k ends; 0 if it was merged away
    bits = n.bit_length()  # heap entries: rank, begin and end of a pair in one integer
    low, heap, rank_of = (1 << bits) - 1, [], ranks.get
    for k in range(n - 1):
        rank = rank_of(piece[k : k + 2])
        if rank is not None:
            heap.append((rank << bits | k) << bits | k + 2)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        stop, k = entry & low, entry >> bits & low
        right = after[k]
        if not end[k] or right >= n or end[right] != stop:
            continue  # one of the two parts has changed since
        end[k], end[right] = stop, 0
        after[k] = then = after[right]
        if then < n:
            before[then] = k
            rank = rank_of(piece[k : end[then]])
            if rank is not None:
                heappush(heap, (rank << bits | k) << bits | end[then])
        left = before[k]
        if left >= 0:
            rank = rank_of(piece[left:stop])
            if rank is not None:
                heappush(heap, (rank << bits | left) << bits | stop)
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k : end[k]]])
        k = after[k]
    return ids


class Codec:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.hash = PerfectHash(list(self.ranks))
        self.slot_ids = np.array([self.ranks[key] for key in self.hash.keys], "<u4")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.memory = WordMemory(self._learn, MAX_WORDS)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        pieces = [word.encode("utf-8") for word in words]
        slots = self.hash.lookup(pieces)
        whole = self.slot_ids[np.maximum(slots, 0)].tobytes()
        ranks = self.ranks
        return [
            whole[4 * k : 4 * k + 4] if slot >= 0 else np.array(heap_merge(pieces[k], ranks), "<u4").tobytes()
            for k, slot in enumerate(slots.tolist())
        ]

    def encode(self, texts: list[str], table: np.ndarray) -> list[bytes]:
        """Ids of each text, as bytes; equal pre-tokens are looked up once while they are remembered."""
        split = pretokens.split_texts(texts, table)
        ids_of = self.memory.table(split).__getitem__
        return [b"".join(map(ids_of, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken"
) -> DataFrame:
    """doc_id, ids (array of int), n_tokens and decoded (bytes, from the ids) of every text.

    Every match of the pre-token pattern is encoded separately, without special tokens, as tiktoken's
    encode_ordinary does. Null text counts as empty: no ids. A null id stays null; repeated rows give a
    row each; an empty table gives none. Other columns are not carried, so their names cannot clash.
    """
    path, packed = tokenizer_path(ranks), pretokens.tiktoken_classes()

    def make():
        codec, table = load_codec(path), pretokens.unpacked(packed)

        def work(texts):
            ids = codec.encode(texts, table)
            return {
                "ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                "n_tokens": [len(x) // 4 for x in ids],
                "decoded": [codec.decode(x) for x in ids],
            }

        return work

    return map_texts(id_and_text(df, id_col, text_col), make, "ids array<int>, n_tokens long, decoded binary")


def bpe_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken"
) -> DataFrame:
    """The same encoding and decoding, but only SHA-256 digests of ids and decoded bytes leave the task.

    Null text counts as empty (no ids, digests of nothing); a null id stays null. Repeated rows and ties give a row each, an empty
    table gives none. Texts of any length are encoded whole. Other columns are not carried, so their names cannot clash.
    """
    path, packed = tokenizer_path(ranks), pretokens.tiktoken_classes()

    def make():
        codec, table = load_codec(path), pretokens.unpacked(packed)

        def work(texts):
            ids = codec.encode(texts, table)
            return {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
            }

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(id_and_text(df, id_col, text_col), make, fields)
