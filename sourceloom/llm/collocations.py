"""Phrases whose words occur together more often than apart, counted by FM-indexes over shards of word ids.

1. Every task turns its texts into shards: one language each, word ids of the shard's own dictionary, 0 between pieces.
2. Words are summed across shards; in each shard words under the least count become 0, as no candidate can hold them.
3. An FM-index of each shard gives its bigrams with counts (backward extension of all words' intervals); they are summed across shards, and
   each shard gets back which of its bigrams reach the least count. Between the words of all others a 0 is put.
4. A bidirectional FM-index of what is left extends intervals to the left (3 words), then to the right (4 words). Sums across shards
   are exact counts, as every phrase of the least count only holds words and bigrams of the least count.
5. Candidates are scored by their cuts, and those inside longer ones are dropped.

Nothing is broadcast; a shard is bounded, and whatever grows with the table is a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Words of one shard, about; only a single piece of text may make a shard larger.
SHARD_WORDS = 3_000_000
#: Bits of a word's number: the task of its first shard and the place there make the shard's number, then comes the place in the shard.
TASK_BITS, SHARD_BITS, WORD_BITS = 18, 18, 27
#: Words of the table for each bucket that the counts of shards are summed in.
BUCKET_WORDS = 2_000_000
#: Last words whose numbers are equal but for so many bits share a bucket, so that they stand close in it.
RUN_BITS = 6
#: Copies of the table of counts, so that the parts of candidates with a frequent word are dealt to several tasks.
SALTS = 8
BREAK = 0xFF  # no byte of UTF-8

_FOLD = bytearray(range(256))
for _k in range(ord("A"), ord("Z") + 1):
    _FOLD[_k] += 32
for _k in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_k] = BREAK
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


def _slices(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, with b"\\xff" between pieces, in lists of bounded size that end where a piece ends."""
    text, begin, mark = text.translate(_FOLD), 0, bytes([BREAK])
    while begin < len(text):
        end = text.find(mark, begin + limit) + 1 or len(text)
        yield text[begin:end].replace(mark, b" \xff ").split()
        begin = end


class _Ids(dict):
    """Word to id, in the order of first use; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({bytes([BREAK]): 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    def __init__(self, lang: str):
        self.lang, self.ids, self.parts, self.size = lang, _Ids(), [np.zeros(1, np.int32)], 1

    def add(self, words: list[bytes]) -> None:
        part = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.parts += [part, np.zeros(1, np.int32)]
        self.size += len(part) + 1


_ZSTD = "zstd"


def _pack(ids: np.ndarray) -> dict:
    data = ids.astype(np.int32).tobytes()
    return {"n_ids": len(ids), "ids": pa.compress(data, _ZSTD, asbytes=True)}


def _unpack(n_ids: int, ids: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, n_ids * 4, _ZSTD, asbytes=True), np.int32)


_SHARD_SCHEMA = "shard long, lang string, n_ids long, ids binary, words array<string>, counts array<long>"


def _write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) to shards; when a task's open shards are full together, the largest is written."""
    open_shards: dict[str, _Shard] = {}
    base, written = TaskContext.get().partitionId() << SHARD_BITS, 0

    def row(shard: _Shard) -> pa.RecordBatch:
        nonlocal written
        if base >> (TASK_BITS + SHARD_BITS) or written >> SHARD_BITS or len(shard.ids) >> WORD_BITS:
            raise ValueError("a word's number has too few bits for so many tasks, shards of a task or words of a shard")
        ids = np.concatenate(shard.parts)
        counts = np.bincount(ids, minlength=len(shard.ids))[1:]
        words = pa.array(list(shard.ids)[1:], pa.binary()).cast(pa.string())
        packed = _pack(ids)
        out = pa.RecordBatch.from_arrays(
            [pa.array([base + written], pa.int64()), pa.array([shard.lang]), pa.array([packed["n_ids"]], pa.int64()), pa.array([packed["ids"]], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
             pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64()))],
            names=["shard", "lang", "n_ids", "ids", "words", "counts"])
        written += 1
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for words in _slices(text.as_buffer().to_pybytes()):
                shard = open_shards.get(lang)
                if shard is None:
                    shard = open_shards[lang] = _Shard(lang)
                shard.add(words)
                if shard.size >= SHARD_WORDS:
                    yield row(open_shards.pop(lang))
            if sum(s.size for s in open_shards.values()) >= 2 * SHARD_WORDS:
                yield row(open_shards.pop(max(open_shards, key=lambda k: open_shards[k].size)))
    while open_shards:
        yield row(open_shards.popitem()[1])


class FMIndex:
    """An FM-index over word ids whose suffixes are sorted by their first `depth` words; 0 is never extended.

    Intervals of patterns of up to `depth` words are those of the fully sorted index.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        rank, width = ids.astype(np.int64), 1
        order = None
        while width < depth:
            step = min(width, depth - width)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:]
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            width += step
        if order is None:
            order = np.argsort(rank, kind="stable")
        self.n, self.symbols = n, int(ids.max(initial=0)) + 1
        self.bwt = ids[order - 1].astype(np.int64)  # before the first word stands the last, a 0
        self.before = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=self.symbols))))
        self.places = np.sort(self.bwt * n + np.arange(n))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with their intervals."""
        words = 1 + np.flatnonzero(np.diff(self.before[1:]))
        return words, self.before[words], self.before[words + 1]

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """owner, word, low, high and smaller of each word that stands before an interval.

        owner is the interval's place in the arguments; smaller counts the symbols before that interval that are less than the word: the
        place of the longer pattern in the owner's interval of the reversed index.
        """
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        key = np.sort(owner * self.symbols + self.bwt[rows])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        owner, word = key[first] // self.symbols, key[first] % self.symbols
        smaller = first - (np.cumsum(sizes) - sizes)[owner]
        real = word > 0
        owner, word, count, smaller = owner[real], word[real], count[real], smaller[real]
        # LF: all smaller words, and those before `low` in the transform that are this word
        begin = np.searchsorted(self.places, word * self.n + low[owner])
        return owner, word, begin, begin + count, smaller


def _bigrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index = FMIndex(ids, 2)
    last, low, high = index.words()
    owner, word, low, high, _ = index.extend(low, high)
    return word, last[owner], high - low


def _longer(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of 3 and 4 words (rows of four ids, 0 where there is no fourth) with counts."""
    forward, backward = FMIndex(ids, 4), FMIndex(ids[::-1], 4)
    words, low, high = forward.words()
    phrase, mirror = words[:, None], backward.before[words]
    for _ in range(2):  # to the left, the reversed interval kept in step
        owner, word, low, high, smaller = forward.extend(low, high)
        phrase, mirror = np.column_stack([word, phrase[owner]]), mirror[owner] + smaller
    three, counts = phrase, high - low
    owner, word, low, high, _ = backward.extend(mirror, mirror + counts)
    four = np.column_stack([three[owner], word])
    three = np.column_stack([three, np.zeros(len(three), np.int64)])
    return np.concatenate([three, four]), np.concatenate([counts, high - low])


def _kept_words(ids: np.ndarray, local: np.ndarray) -> np.ndarray:
    """ids in terms of places in local (from 1); others become 0, and runs of 0 become one."""
    place = np.zeros(max(int(ids.max(initial=0)), int(local.max(initial=0))) + 1, np.int64)
    place[local] = np.arange(1, len(local) + 1)
    return _one_break(place[ids])


def _one_break(ids: np.ndarray) -> np.ndarray:
    zero = ids == 0
    ids = ids[~(zero & np.concatenate(([False], zero[:-1])))]
    return np.concatenate(([0], ids, [0])) if len(ids) and (ids[0] or ids[-1]) else ids


def _kept_bigrams(ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """ids with a 0 between all neighbours but those of the given bigrams."""
    width = int(max(ids.max(initial=0), first.max(initial=0), second.max(initial=0))) + 1
    wanted = np.sort(first * width + second)
    pairs = ids[:-1] * width + ids[1:]
    at = np.minimum(np.searchsorted(wanted, pairs), max(len(wanted) - 1, 0))
    apart = wanted[at] != pairs if len(wanted) else np.ones(len(pairs), bool)
    cuts = np.flatnonzero(apart) + 1
    return _one_break(np.insert(ids, cuts, 0))


def _list(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    return np.asarray(column[k].values.to_numpy(zero_copy_only=False), np.int64)


def _pack_rows(rows: np.ndarray) -> bytes:
    """Sorted columns (the last: counts) as differences, whose bytes of one place stand together; about 3 bytes for a row of two words."""
    steps = np.diff(rows, axis=1, prepend=0)
    steps[-1] = rows[-1]
    steps = (steps << 1) ^ (steps >> 63)  # small ones of either sign become small
    places = np.ascontiguousarray(steps).view(np.uint8).reshape(*steps.shape, 8).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(places).tobytes(), _ZSTD, asbytes=True)


def _unpack_rows(n_columns: int, n_rows: int, data: bytes) -> np.ndarray:
    places = np.frombuffer(pa.decompress(data, n_columns * n_rows * 8, _ZSTD, asbytes=True), np.uint8).reshape(n_columns, 8, n_rows)
    steps = np.ascontiguousarray(places.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    rows = ((steps >> np.uint64(1)) ^ (np.uint64(0) - (steps & np.uint64(1)))).view(np.int64)
    rows[:-1] = np.cumsum(rows[:-1], axis=1)
    return rows


_PACKED = "bucket int, shard long, n_rows int, data binary"


def _packed(shard: int, columns: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """The rows of a shard (columns of words' numbers, then counts) in a row for each bucket. Rows of the same words are in the same bucket."""
    *keys, _ = columns
    mixed = np.zeros(len(keys[0]), np.uint64)
    for key in [*keys[:-1], keys[-1] >> RUN_BITS]:
        mixed = (mixed ^ (mixed >> np.uint64(32)) ^ key.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((mixed >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((*keys[::-1], bucket))
    rows, ends = np.stack(columns)[:, order], np.cumsum(np.bincount(bucket, minlength=n_buckets))
    sizes = np.diff(ends, prepend=0)
    found = np.flatnonzero(sizes)
    data = [_pack_rows(rows[:, ends[k] - sizes[k] : ends[k]]) for k in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), pa.array(np.full(len(found), shard), pa.int64()), pa.array(sizes[found], pa.int32()), pa.array(data, pa.binary())],
        names=["bucket", "shard", "n_rows", "data"])


def _summed(bucket: pa.Table, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all shards in a bucket by words, then by shards: the rows, their shards, where other words begin, and sums of counts."""
    sizes = bucket["n_rows"].to_pylist()
    rows = np.concatenate([_unpack_rows(n_keys + 1, n, data) for n, data in zip(sizes, bucket["data"].to_pylist())], axis=1)
    shard = np.repeat(bucket["shard"].to_numpy(), sizes)
    order = np.lexsort((shard, *rows[:n_keys][::-1]))
    rows, shard = rows[:, order], shard[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[:n_keys, 1:] != rows[:n_keys, :-1]).any(axis=0))))
    return rows, shard, first, np.add.reduceat(rows[n_keys], first)


def _table(names: list[str], columns: list[np.ndarray]) -> pa.Table:
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})


_FREQUENT = "shard long, n_rows int, data binary"


def _frequent_bigrams(least: int):
    """A bucket's bigrams that reach the least count: packed with their counts in a row without a shard, and in a row for each shard that holds some of them."""

    def run(bucket: pa.Table) -> pa.Table:
        rows, shard, first, f = _summed(bucket, 2)
        kept = np.flatnonzero(np.repeat(f >= least, np.diff(np.append(first, len(shard)))))
        kept = kept[np.argsort(shard[kept], kind="stable")]
        once = first[f >= least]
        parts = [np.stack([*rows[:2, once], f[f >= least]])] if len(once) else []
        shards = [None] * len(parts)
        ends = np.flatnonzero(np.diff(shard[kept], append=-1))
        for own in np.split(kept, ends[:-1] + 1) if len(kept) else []:
            shards.append(int(shard[own[0]]))
            parts.append(np.stack([*rows[:2, own], np.zeros(len(own), np.int64)]))  # the shard's own counts are not asked for again
        return pa.table({
            "shard": pa.array(shards, pa.int64()), "n_rows": pa.array([x.shape[1] for x in parts], pa.int32()), "data": pa.array([_pack_rows(x) for x in parts], pa.binary())})

    return run


def _bigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed bigrams with counts to rows w1, w2 and f."""
    for batch in batches:
        for n, data in zip(batch["n_rows"].to_pylist(), batch["data"].to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpack_rows(3, n, data)], names=["w1", "w2", "f"])


def _frequent_longer(least: int):
    def run(bucket: pa.Table) -> pa.Table:
        rows, _, first, f = _summed(bucket, 4)
        kept = f >= least
        return _table(["w1", "w2", "w3", "w4", "f"], [*rows[:4, first[kept]], f[kept]])

    return run


def _count_bigrams(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                local, names = _list(batch["local"], k), _list(batch["word"], k)
                order = np.argsort(local)
                local, names = local[order], names[order]
                ids = _kept_words(_unpack(batch["n_ids"][k].as_py(), batch["ids"][k].as_py()), local)
                if not ids.any():
                    continue
                a, b, n = _bigrams(ids)
                yield _packed(batch["shard"][k].as_py(), [names[a - 1], names[b - 1], n], n_buckets)

    return run


def _count_longer(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                local, names = _list(batch["local"], k), _list(batch["word"], k)
                order = np.argsort(names)
                local, names = local[order], names[order]
                packed = zip(batch["sizes"][k].as_py(), batch["packed"][k].as_py())
                bigrams = np.concatenate([_unpack_rows(3, n, data)[:2] for n, data in packed], axis=1)
                first, second = 1 + np.searchsorted(names, bigrams)
                ids = _kept_words(_unpack(batch["n_ids"][k].as_py(), batch["ids"][k].as_py()), local)
                ids = _kept_bigrams(ids, first, second)
                if not ids.any():
                    continue
                phrases, n = _longer(ids)
                named = np.concatenate(([-1], names))[phrases]
                yield _packed(batch["shard"][k].as_py(), [*named.T, n], n_buckets)

    return run


def mine_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words (word, lang, text, f), phrases (words: an array of two to four numbers of words, f) and totals (lang, n).

    Only words and phrases with f >= least are given. Null texts have no words, null languages are `und`; repeated rows count each;
    long texts count whole; other columns are not read; an empty table gives none.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    shards = cut_lineage(texts.mapInArrow(_write_shards, _SHARD_SCHEMA))
    n_buckets = 1 + (shards.agg(F.sum("n_ids")).first()[0] or 0) // BUCKET_WORDS
    used = shards.select(F.shiftleft("shard", WORD_BITS).alias("own"), "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w")).select(
        (F.col("own") + F.col("k") + 1).alias("own"), F.concat_ws("\n", "lang", "w.words").alias("text"), F.col("w.counts").alias("n"))
    totals = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    # a word has a row in each shard that holds it; it is numbered by the first of them
    word = Window.partitionBy("text")
    known = used.select("*", F.sum("n").over(word).alias("f"), F.min("own").over(word).alias("word")).where(F.col("f") >= least)
    known = cut_lineage(known.select("own", "text", "f", "word"))
    words = known.where("own = word").select(
        "word", F.regexp_extract("text", r"(?s)^(.*)\n", 1).alias("lang"), F.substring_index("text", "\n", -1).alias("text"), "f")

    local = F.col("own").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    lists = known.select(F.shiftright("own", WORD_BITS).alias("shard"), local.alias("local"), "word").groupBy("shard").agg(F.collect_list(F.struct("local", "word")).alias("w"))
    lists = lists.select("shard", F.col("w.local").alias("local"), F.col("w.word").alias("word"))
    listed = shards.select("shard", "n_ids", "ids").join(lists.hint("merge"), "shard")  # lists grow with the table: never broadcast
    # a bigram has a row in each shard that holds it; rows travel packed, a bucket of each shard together
    counted = listed.mapInArrow(_count_bigrams(n_buckets), _PACKED)
    pairs = cut_lineage(counted.groupBy("bucket").applyInArrow(_frequent_bigrams(least), _FREQUENT))
    two = pairs.where("shard is null").mapInArrow(_bigram_rows, "w1 long, w2 long, f long").select(F.array("w1", "w2").alias("words"), "f")

    # what a shard gets back stays packed too: a frequent bigram is in nearly every shard of its language
    frequent = pairs.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("n_rows", "data")).alias("p"))
    frequent = frequent.select("shard", F.col("p.n_rows").alias("sizes"), F.col("p.data").alias("packed"))
    more = listed.join(frequent.hint("merge"), "shard").mapInArrow(_count_longer(n_buckets), _PACKED)
    more = more.groupBy("bucket").applyInArrow(_frequent_longer(least), "w1 long, w2 long, w3 long, w4 long, f long")
    longer = more.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w >= 0).alias("words"), "f")
    return words, cut_lineage(two.unionByName(longer)), totals


def _salt(part: Column | None = None) -> Column:
    """The copy of a part's count that a candidate meets: single words, which very many candidates may share, have several copies."""
    salt = F.pmod(F.xxhash64("words"), F.lit(SALTS)).cast("int")
    return salt if part is None else F.when(F.size(part) == 1, salt).otherwise(0)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Phrases are ordered by score, then a, both falling, then by the bytes of the phrase. A phrase inside a longer candidate that occurs in
    `share` per cent of its places is left out. Nulls, empty and long texts, repeated rows and empty tables: see mine_phrases.
    """
    words, phrases, totals = mine_phrases(df, text_col, lang_col, least)
    size = F.size("words")
    longer = phrases.where(size > 2).select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), k -> slice(words, k, n))))")).alias("words"))
    inside = longer.groupBy("words").agg(F.max("f").alias("longer"))
    kept = phrases.join(inside, "words", "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True))).drop("longer")

    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parts = words.select(F.array("word").alias("part"), "f", copies).unionByName(phrases.select(F.col("words").alias("part"), "f", F.lit(0).alias("salt")))
    cuts = kept.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, 4)").alias("right"))
    for side in ("left", "right"):
        counts = parts.select(F.col("part").alias(side), "salt", F.col("f").alias(side[0]))
        cuts = cuts.withColumn("salt", _salt(F.col(side))).join(counts, [side, "salt"]).drop("salt", side)
    score = F.expr("(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l as decimal(20, 0)) + r)").cast("long")
    scored = cuts.withColumn("score", score).groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("words", "a", "c.score", "c.l", "c.r")

    names = words.select("word", "lang", "text", copies)
    rows = scored.select("*", _salt().alias("salt"), F.posexplode("words").alias("at", "word")).join(names, ["word", "salt"])
    rows = rows.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("w"))
    rows = rows.select("lang", F.array_join("w.text", " ").alias("phrase"), "a", "l", "r", "score", _salt().alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
