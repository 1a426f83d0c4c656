"""SimHash near-duplicates by multi-index hashing.

A fingerprint of B bits is cut into m segments; there is a table for each. If two fingerprints differ in
at most r bits, some segment differs in at most floor(r / m). That segment's Hamming ball is enumerated:
of radius 0 where the floor is 0; on the side that has the differing bit set where it is 1; of radius 1
on both sides, which meet half way, where it is 2. Fingerprints that meet under a key of a table are
candidates, and their complete distance decides. So no link is lost for r < 3 m.

Equal fingerprints are one node. Within a key only links to the smallest reachable node are given, at
most one per row, so large groups of copies do not give all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, map_texts
from .components import connected_components

#: Rows of one key above which links are searched outwards from one row after the other.
LARGE_KEY = 4096
#: Candidate pairs that are compared in one vectorised step.
PAIR_BLOCK = 2_000_000


def fingerprint(text: str, words: int, seeds: tuple[int, ...]) -> list[int]:
    """64 bits for each seed, as signed integers: a bit is set if over half the shingles' hashes have it.

    Lower-cases A-Z, takes words between ASCII white space and shingles with repeats; fewer words than a
    shingle has are one shingle; no words give zero.
    """
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return [0] * len(seeds)
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        shingles = [line]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[: n - 1].tolist()]
        shingles = [line[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    out = []
    for seed in seeds:
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        counts = bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(df: DataFrame, words: int, n_bits: int) -> DataFrame:
    """Adds f0, f1, ... (64 bits each) to a table with a text column; text itself is not kept."""
    seeds = tuple(42 + k for k in range(n_bits // 64))

    def make():
        def work(texts):
            found = [fingerprint(t, words, seeds) for t in texts]
            return {f"f{k}": pa.array([f[k] for f in found], pa.int64()) for k in range(len(seeds))}

        return work

    return map_texts(df, make, ", ".join(f"f{k} long" for k in range(len(seeds))))


def _with_keys(nodes: DataFrame, names: list[str], n_segments: int, radius: int) -> DataFrame:
    """A row for each table and each member of the ball that is enumerated there."""
    width = 64 * len(names) // n_segments
    reach = radius // n_segments
    if reach > 2 or 64 % width:
        raise ValueError("radius must be below three times the number of segments, which must divide the bits evenly")
    per_word = 64 // width
    place = F.col("k") % (width + 1)  # the bit that is flipped; width: none
    table = F.floor(F.col("k") / (width + 1)).cast("int")
    mask = (1 << width) - 1
    rows = nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_segments * (width + 1) - 1))).alias("k"))
    rows = rows.select(*nodes.columns, table.alias("table"), place.cast("int").alias("place"))
    word = F.col(names[0])
    for k, name in enumerate(names[1:], 1):
        word = F.when(F.col("table") >= k * per_word, F.col(name)).otherwise(word)
    value = F.expr("shiftrightunsigned(word, cast((table % {0}) * {1} as int))".format(per_word, width)).bitwiseAND(F.lit(mask))
    rows = rows.withColumn("word", word).withColumn("value", value)
    if reach == 0:
        rows = rows.where(F.col("place") == width)
    elif reach == 1:
        rows = rows.where((F.col("place") == width) | (F.expr("shiftright(value, place)").bitwiseAND(F.lit(1)) == 1))
    flipped = F.when(F.col("place") == width, F.col("value")).otherwise(
        F.col("value").bitwiseXOR(F.expr("shiftleft(cast(1 as bigint), place)"))
    )
    key = F.shiftleft(F.col("table").cast("long"), 40).bitwiseOR(flipped)
    return rows.select(key.alias("key"), *nodes.columns)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, in blocks of bounded size."""
    ends = np.repeat(starts + sizes, sizes)
    rows = np.arange(starts[0], starts[0] + sizes.sum()) if len(starts) and (np.diff(starts) == sizes[:-1]).all() else np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
    after = ends - rows - 1
    total = np.cumsum(after)
    first = 0
    while first < len(rows):
        base = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + PAIR_BLOCK, side="right")))
        n = after[first:last]
        left = np.repeat(rows[first:last], n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield left, left + 1 + offset
        first = last


def _distance(words: list[np.ndarray], a, b) -> np.ndarray:
    total = np.bitwise_count(words[0][a] ^ words[0][b])
    for w in words[1:]:
        total = total + np.bitwise_count(w[a] ^ w[b])
    return total


def _links_of_keys(keys: np.ndarray, nodes: np.ndarray, words: list[np.ndarray], radius: int):
    """Links (node, smallest node that it reaches under its key) of whole keys, rows sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    several = sizes > 1
    starts, sizes = starts[several], sizes[several]
    found_a, found_b = [], []
    small = sizes <= LARGE_KEY
    if small.any():
        for a, b in _pairs(starts[small], sizes[small]):
            near = _distance(words, a, b) <= radius
            found_a.append(a[near])
            found_b.append(b[near])
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        left = np.arange(start, start + size)
        while len(left):  # outwards from one row; rows that were reached leave the search
            front, left = [left[0]], left[1:]
            while front and len(left):
                row = front.pop()
                near = _distance(words, left, row) <= radius
                if near.any():
                    reached = left[near]
                    found_a.append(np.full(len(reached), row))
                    found_b.append(reached)
                    front.extend(reached.tolist())
                    left = left[~near]
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    if not len(a):
        return nodes[:0], nodes[:0]
    rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(rows))
    while True:  # smallest row that each row reaches; rows of different keys never meet
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    linked = label != np.arange(len(rows))
    return nodes[rows[linked]], nodes[rows[label[linked]]]


def _sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of whole keys from batches that are sorted by key; a key may span batches."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
        last = part["key"][-1]
        cut = int(np.searchsorted(part["key"], last))
        if cut or held and held[-1]["key"][-1] != last:
            whole = [*held, {n: v[:cut] for n, v in part.items()}]
            yield {n: np.concatenate([h[n] for h in whole]) for n in part}
            held = []
        held.append({n: v[cut:] for n, v in part.items()})
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def near_links(nodes: DataFrame, names: list[str], n_segments: int, radius: int) -> DataFrame:
    """Links a, b of nodes (node long, one long for each of names) within radius bits, by tables of segments.

    Pairs within a key that are joined through others there are not repeated: components are complete,
    single pairs are not listed.
    """
    plain = names == ["node"]
    rows = _with_keys(nodes.select("node", *([] if plain else names)), names, n_segments, radius)
    rows = rows.repartition(F.col("key")).sortWithinPartitions("key")

    def run(batches):
        for block in _sorted_keys(batches):
            words = [block[n].view(np.uint64) for n in names]
            a, b = _links_of_keys(block["key"], block["node"], words, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, n_bits: int = 64,
    n_segments: int = 2, radius: int = 2,
) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id (smallest doc_id reachable) of every row.

    Rows are linked if their fingerprints differ in at most radius bits. Null text counts as empty;
    empty texts have fingerprint zero and link like any other. Rows of null id keep their links; their
    component's id is null only if no row of it has an id. Repeated rows give a row each; an empty table
    gives none. Other columns are not carried, so their names cannot clash.
    """
    names = [f"f{k}" for k in range(n_bits // 64)]
    prints = cut_lineage(fingerprints(id_and_text(df, id_col, text_col), words, n_bits))
    groups = component_table(prints, names, n_segments, radius, F.min("doc_id").alias("component_id"))
    text = F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in reversed(names)])
    return prints.join(groups, names).select("doc_id", text.alias("fingerprint"), "component_id")


def component_table(prints: DataFrame, names: list[str], n_segments: int, radius: int, least) -> DataFrame:
    """The aggregate `least` (a minimum) over the whole component, for each distinct fingerprint."""
    node = F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)
    column = "component_id"
    nodes = cut_lineage(prints.groupBy(*names).agg(least).withColumn("node", node))
    keyed = ["node"] if len(names) == 1 else names
    links = near_links(nodes, keyed, n_segments, radius)
    roots = connected_components(links)
    linked = nodes.join(roots, "node")
    of_root = linked.groupBy("root").agg(F.min(column).alias("_least"))
    joined = linked.select("node", "root").join(of_root, "root").select("node", "_least")
    known = nodes.join(joined, "node", "left")
    # a linked component may have no id at all; then its minimum is null like the node's own
    return known.select(*names, F.coalesce("_least", column).alias(column))
