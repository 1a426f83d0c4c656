"""SimHash near-duplicates whose links are verified on the whole shingle sets.

Texts of one shingle set are one node with a fingerprint of 1024 bits and, for each of the 22 segments of 23 bits in its first half,
the 4 least certain bits: those whose counts are nearest to half of the shingles. Candidates come from a table of
segments: each node enters under the segment as it is and under the ball around it that flips one of those bits, so
two nodes meet under a key if they differ there in up to two such bits.

At a similarity of 0.8 a bit differs with probability 0.151, and differing bits are nearly always uncertain ones: of
random sets of 45 to 400 shingles 0.989 to 0.995 meet in some segment, of 9 shingles 0.965; more similar ones nearly always. Sets of up to 8
shingles are linked exactly: one of n shingles reaches 0.8 only with sets that hold it and have at most n / 4 shingles more, so sets of 5 to 10
shingles look up the digests of what is left of them without one or two. Whole balls of radius 1 would take 24 keys a segment instead of 5. Unrelated nodes meet
in 7 of 100,000 pairs; for over ten million nodes take wider segments, and more of them (28 bits: 36).

Rows of the table carry 64 bits from elsewhere in the fingerprint, whose distance leaves one in a hundred of unrelated nodes that
meet; complete distances, then the exact Jaccard similarity of the shingle sets, decide.

Links are sought twice: each node of a key against the key's smallest node; then, within the keys that still hold
several components, every pair of two components, in blocks of bounded size, each pair under its smallest common key. There the
table keeps the rows that have such a partner, their sets are fetched, and the blocks are compared once more with them. So
large groups of copies do not give all their pairs, but no candidate pair between two components is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_texts
from .components import connected_components
from .simhash import _distance, _pairs, _sorted_keys

SEGMENTS, WIDTH, UNSURE = 22, 23, 4
#: Bits in which sets at the similarity may differ: three standard deviations over the mean of 155.
MOST_BITS = 189
#: Small sets have more bits that tie, and so larger distances: this, divided by the set's size, is added.
MORE_BITS = 320
#: Bits of the 64 that rows carry in which they may differ: four standard deviations over the mean of 9.7.
MOST_HINT_BITS = 22
#: Smaller sets are linked by the digests of sets within sets, whatever their fingerprints are.
SMALL = 9
#: The least similarity that segments, bits and small sets are made for.
LEAST_SIMILARITY = 0.8
#: Rows of a key that are compared in one block.
KEY_BLOCK = 2048

_WORDS = 16
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, (2, _WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_NAMES = [f"f{k}" for k in range(_WORDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.

    Lower-cases A-Z and takes words between ASCII white space; fewer words than a shingle has are one
    shingle, and so are no words.
    """
    parts = text.encode("utf-8").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1 if size else 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += _mix(hashes[k : k + n] * _PLACE[k])
    return np.unique(_mix(total))


def set_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (16 words each), and the bits of each segment that are nearest to a tie, in the order of their places."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    # runs of at most 255 shingles, so that counts fit into bytes
    runs = -(-sizes // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(ends - sizes - 255 * first_run, runs) + 255 * np.arange(runs.sum())
    hashes = np.concatenate(sets)
    counts = np.empty((len(sets), _WORDS, 8, 8), np.int64)
    for word in range(_WORDS):
        mixed = _mix(hashes * _ODD[0, word] + _ODD[1, word])
        for bit in range(8):
            lanes = np.add.reduceat((mixed >> np.uint64(bit)) & _LANES, starts)
            counts[:, word, :, bit] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
    margins = 2 * counts.reshape(len(sets), -1) - sizes[:, None]
    prints = np.packbits(margins > 0, axis=1, bitorder="little").view("<u8")
    parts = np.abs(margins[:, : SEGMENTS * WIDTH]).reshape(-1, SEGMENTS, WIDTH)
    ranked = np.partition(parts * WIDTH + np.arange(WIDTH), UNSURE - 1, axis=2)[:, :, :UNSURE]
    return prints, np.sort(ranked % WIDTH, axis=2).astype(np.uint8)


def segment_keys(prints: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint: of every segment the value itself, and the value with one uncertain bit flipped."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * WIDTH]
    values = bits.reshape(-1, SEGMENTS, WIDTH).astype(np.int64) @ (np.int64(1) << np.arange(WIDTH))
    ball = np.concatenate([values[:, :, None], values[:, :, None] ^ (np.int64(1) << unsure.astype(np.int64))], axis=2)
    return (ball + (np.arange(SEGMENTS)[None, :, None] << WIDTH)).reshape(len(prints), -1)


def sets_within(own: np.ndarray) -> list[np.ndarray]:
    """The sets of less than SMALL shingles inside a set that have four fifths of its shingles or more, but not all."""
    n = len(own)
    return [np.delete(own, gone) for k in (1, 2) if 0 < n - k < SMALL and 5 * (n - k) >= 4 * n for gone in map(list, combinations(range(n), k))]


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)


def _sketches(source: DataFrame, words: int) -> DataFrame:
    """Adds s0 and s1 (digest of the shingle set), n (its size), the fingerprint, its uncertain bits, and s0 of the sets_within."""

    def make():
        def work(texts):
            sets = [shingle_set(t, words) for t in texts]
            digests = _digests(sets)
            prints, unsure = set_fingerprints(sets)
            return {
                "s0": pa.array(digests[:, 0].copy()), "s1": pa.array(digests[:, 1].copy()), "n": pa.array([len(s) for s in sets], pa.int32()),
                **{name: pa.array(prints[:, k].astype(np.int64)) for k, name in enumerate(_NAMES)},
                "unsure": pa.array([u.tobytes() for u in unsure], pa.binary()),
                "within": pa.array([_digests(inner)[:, 0].tolist() if (inner := sets_within(s)) else [] for s in sets], pa.list_(pa.int64())),
            }

        return work

    return map_texts(source, make, ", ".join(["s0 long, s1 long, n int", *(f"{name} long" for name in _NAMES), "unsure binary", "within array<bigint>"]))


def _keyed(nodes: DataFrame) -> DataFrame:
    """key, node and hint (a word of the fingerprint that the key's segment is not in) for each key of each node."""
    hints = np.repeat((np.arange(SEGMENTS) * WIDTH // 64 + _WORDS // 2) % _WORDS, 1 + UNSURE)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prints = np.stack([part.column(k + 1).to_numpy() for k in range(_WORDS)], axis=1).view(np.uint64)
                unsure = np.frombuffer(b"".join(part.column(_WORDS + 1).to_pylist()), np.uint8).reshape(-1, SEGMENTS, UNSURE)
                keys = segment_keys(np.ascontiguousarray(prints), unsure)
                of = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                hint = prints[:, hints].ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(of), pa.array(hint)], names=["key", "node", "hint"])

    return nodes.select("node", *_NAMES, "unsure").mapInArrow(run, "key long, node long, hint long")


def _sets(source: DataFrame, words: int) -> DataFrame:
    """Adds the shingle set as a sorted array."""

    def work(texts):
        sets = [np.sort(shingle_set(t, words).view(np.int64)) for t in texts]
        offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        return {"shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))}

    return map_texts(source, lambda: work, "shingles array<bigint>")


def _met(rows: DataFrame, other: str) -> DataFrame:
    """Distinct pairs a < b of node and other.node in the same row whose hints are near."""
    near = F.bit_count(F.col("hint").bitwiseXOR(F.col(f"{other}.hint"))) <= MOST_HINT_BITS
    rows = rows.where((F.col("node") != F.col(f"{other}.node")) & near)
    return rows.select(F.least("node", f"{other}.node").alias("a"), F.greatest("node", f"{other}.node").alias("b")).distinct()


def _candidates(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sizes and complete fingerprints allow the similarity."""
    side = nodes.select("node", "n", *_NAMES)
    for name in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in side.columns[1:])), name)
    distance = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _NAMES), F.lit(0))
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return cut_lineage(pairs.where((small >= similarity * large) & (distance <= MOST_BITS + MORE_BITS / small)).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets have that Jaccard similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), shared.alias("both"))
    return cut_lineage(both.where(F.col("both") / (F.col("p") + F.col("q") - F.col("both")) >= similarity).select("a", "b"))


def _shingles_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node and shingles of every node that is wanted."""
    rows = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "_k0", "_k1")
    return cut_lineage(_sets(texts.join(rows, ["_k0", "_k1"]).select("node", "text"), words).dropDuplicates(["node"]))


def _smallest_common(prints: np.ndarray, unsure: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest key that the rows i and j share."""
    x, y = (segment_keys(prints[k], unsure[k]).reshape(len(k), SEGMENTS, 1 + UNSURE) for k in (i, j))
    shared = (x[:, :, :, None] == y[:, :, None, :]).any(axis=3)
    return np.where(shared, x, np.iinfo(np.int64).max).min(axis=(1, 2))


def _shared_sizes(sets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets of rows i and j; i is in order."""
    out = np.empty(len(i), np.int64)
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for a, b in zip(first, [*first[1:], len(i)]):
        own = sets[i[a]]
        others = [sets[k] for k in j[a:b]]
        values = np.concatenate(others)
        found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        out[a:b] = np.add.reduceat(found.astype(np.int64), np.cumsum([0, *(len(o) for o in others[:-1])]))
    return out


def _blocks_of_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, count, node, n, root, fingerprint, unsure) dealt into blocks of their keys; group names two blocks that meet.

    A task compares two blocks, so no task holds a whole large key.
    """
    n_blocks = F.ceil(F.col("count") / KEY_BLOCK).cast("int")
    rows = rows.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(
        group.alias("key"), F.col("key").alias("own_key"), (F.col("block") == F.col("other")).alias("own"), "block", "node", "n", "root", *_NAMES, "unsure")


def _partners(part: dict, similarity: float):
    """Pairs of rows of one group but of two roots whose sizes and complete fingerprints allow the similarity, under their smallest common key."""
    starts = np.flatnonzero(np.r_[True, part["key"][1:] != part["key"][:-1]])
    sizes = np.diff(np.r_[starts, len(part["key"])])
    words = [part[name].view(np.uint64) for name in _NAMES]
    prints = np.stack(words, axis=1)
    unsure = np.frombuffer(b"".join(part["unsure"]), np.uint8).reshape(-1, SEGMENTS, UNSURE)
    for i, j in _pairs(starts, sizes):
        apart = (part["root"][i] != part["root"][j]) & (part["own"][i] | (part["block"][i] != part["block"][j]))
        i, j = i[apart], j[apart]
        small, large = np.minimum(part["n"][i], part["n"][j]), np.maximum(part["n"][i], part["n"][j])
        near = (small >= similarity * large) & (_distance(words, i, j) <= MOST_BITS + MORE_BITS / small)
        i, j = i[near], j[near]
        for at in range(0, len(i), 10_000):
            x, y = i[at : at + 10_000], j[at : at + 10_000]
            here = _smallest_common(prints, unsure, x, y) == part["own_key"][x]
            if here.any():
                yield x[here], y[here]


def _for_nodes(rows: DataFrame, columns: list[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (key, count, node and columns that depend on it) with those of table (by node): the keys of a node, at most
    SEGMENTS * (1 + UNSURE), wait in one row, so that the join has a row for each node instead of one for each key."""
    held = rows.groupBy("node", *columns).agg(F.collect_list(F.struct("key", "count")).alias("keys"))
    return held.join(table, "node", how).withColumn("_k", F.explode("keys")).select("*", "_k.key", "_k.count").drop("_k", "keys")


def _across(rows: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links a, b within keys and between roots; rows: key, count (of rows in the key), node and root."""
    rows = _blocks_of_keys(_for_nodes(rows, ["root"], nodes.select("node", "n", *_NAMES, "unsure")))
    names = rows.columns

    def with_partners(batches):
        for part in _sorted_keys(batches):
            found = [np.concatenate(pair) for pair in _partners(part, similarity)]
            if found:
                kept = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(part[name][kept]) for name in names], names=names)

    def linked(batches):
        for part in _sorted_keys(batches):
            sets = part["shingles"]
            for i, j in _partners(part, similarity):
                both = _shared_sizes(sets, i, j)
                alike = both / (part["n"][i] + part["n"][j] - both) >= similarity
                a, b = part["node"][i[alike]], part["node"][j[alike]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    met = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(with_partners, rows.schema))
    sets = _shingles_of(met.select("node"), nodes, texts, words)
    return cut_lineage(met.join(sets, "node").repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long"))


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links a, b of nodes (node, n, fingerprint, unsure, within, _k0, _k1); texts has text, _k0 and _k1.

    Components of the links are those of all candidate pairs of that similarity; pairs within a component
    that are joined through others are not all listed.
    """
    of_key = Window.partitionBy("key")
    rows = _keyed(nodes).withColumns({"count": F.count("*").over(of_key), "first": F.min(F.struct("node", "hint")).over(of_key)})
    rows = cut_lineage(rows.where(F.col("count") > 1))
    tried = _candidates(_met(rows, "first"), nodes, similarity)
    ends = tried.select(F.explode(F.array("a", "b")).alias("node"))
    inner = nodes.where("n < %d" % SMALL).select(F.col("node").alias("a"), F.col("n").alias("a_n"))
    outer = nodes.select(F.explode("within").alias("a"), F.col("node").alias("b"), F.col("n").alias("b_n"))
    small = outer.join(inner, "a").where(F.col("a_n") >= similarity * F.col("b_n")).select("a", "b")
    links = cut_lineage(_verified(tried, _shingles_of(ends, nodes, texts, words), similarity).unionByName(small))
    known = _for_nodes(rows.where(F.col("count") > 2), [], connected_components(links), "left")
    known = known.withColumn("root", F.coalesce("root", "node")).withColumns({"low": F.min("root").over(of_key), "high": F.max("root").over(of_key)})
    return links.unionByName(_across(known.where("low < high").select("key", "count", "node", "root"), nodes, texts, words, similarity))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without near-duplicates: of each component the row with the smallest id stays, nulls last.

    Rows are linked if the Jaccard similarity of their shingle sets reaches `similarity`; below 0.8, for which segments and bits are set, a
    ValueError is raised. All columns of df are kept as they are, whatever their names. Of rows
    that are equal in id and text one stays. Null and empty texts are one group; an empty table gives no rows. Long
    texts count whole. Nodes are named by 64 bits of their sets' digests.
    """
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"similarity must be at least {LEAST_SIMILARITY}")
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = [F.xxhash64(doc, text).alias("_k0"), F.xxhash64(text, F.lit("near"), doc).alias("_k1")]
    source = df.select(doc.alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *keys)
    prints = cut_lineage(_sketches(source, words))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k0", "_k1")
    carried = [F.first(name).alias(name) for name in ("n", *_NAMES, "unsure", "within")]
    nodes = prints.groupBy("s0", "s1").agg(F.min(rank).alias("least"), *carried)
    nodes = cut_lineage(nodes.select(F.col("s0").alias("node"), "s1", "least", "n", *_NAMES, "unsure", "within", "least._k0", "least._k1"))
    roots = connected_components(similar_links(nodes, source.select("text", "_k0", "_k1"), words, similarity))
    linked = nodes.select("node", "least").join(roots, "node")
    of_root = linked.groupBy("root").agg(F.min("least").alias("_least"))
    joined = linked.select("node", "root").join(of_root, "root").select("node", "_least")
    groups = nodes.select("node", "s1", "least").join(joined, "node", "left").select(F.col("node").alias("s0"), "s1", F.coalesce("_least", "least").alias("least"))
    same = F.struct(F.col("least._k0"), F.col("least._k1"))
    gone = prints.select("s0", "s1", "_k0", "_k1").join(groups, ["s0", "s1"]).where(F.struct("_k0", "_k1") != same).select("_k0", "_k1").distinct()
    kept = df.join(gone, [keys[0] == gone["_k0"], keys[1] == gone["_k1"]], "left_anti")
    if prints.groupBy("_k0", "_k1").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept
