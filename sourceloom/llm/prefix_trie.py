"""The trie of shared beginnings of conversations, by union-find over the LCP edges of sorted neighbours.

Conversations become sequences of turn digests. Equal ones are counted, the distinct ones are sorted in ranges. In a block of neighbours every
edge (the longest common prefix of two) is taken in descending depth: the union of two components is a branching node at that depth, and the
unbranched nodes above a component are written when it is united. Components that hold a block's first or last sequence may go on in the
neighbouring blocks; they are contracted to two spines, the paths of the first and the last sequence with sums of what hangs on them, and are
merged with those of other blocks and, in rounds of 32, of other ranges. Only nodes on spines wait for later rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns of the sequences that are united in one block, about.
BLOCK_TURNS = 200_000
#: Ranges whose forests are merged by one task of a round.
FOREST = 32
#: Ids that are joined to one text before they are hashed in order.
CHUNK_IDS = 20_000
#: Open nodes up to so many (24 bytes each) are broadcast to their children's rows; more are joined by a shuffle.
MOST_BROADCAST = 200_000

_NONE_ENDS = hashlib.sha256(b"").hexdigest()
_SUMS = ("depth", "children", "leaves", "saved", "members", "least")
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_SCHEMA = pa.schema(
    [("range", pa.int64()), ("side", pa.int64()), ("digests", pa.binary()), ("sizes", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.int64())) for name in _SUMS] + [("ends", pa.list_(pa.string())), ("asked", pa.list_(pa.bool_()))]
    + [(f"node_{name}", pa.int64()) for name in _NODE] + [("node_ends", pa.string()), ("node_key", pa.binary()), ("parent_key", pa.binary())])
_DDL = ", ".join(
    ["`range` long, side long, digests binary, sizes array<long>"] + [f"{name} array<long>" for name in _SUMS] + ["ends array<string>, asked array<boolean>"]
    + [f"node_{name} long" for name in _NODE] + ["node_ends string, node_key binary, parent_key binary"])


class _Sum:
    """What is known of one node: sums over its finished children, and rows that wait for its least member."""

    __slots__ = ("children", "leaves", "saved", "members", "least", "ends", "waiting", "asked")

    def __init__(self, children=0, leaves=0, saved=0, members=0, least=None, ends=None, waiting=(), asked=False):
        self.children, self.leaves, self.saved, self.members = children, leaves, saved, members
        self.least, self.ends, self.waiting, self.asked = least, ends, list(waiting), asked

    def add(self, other: _Sum) -> None:
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.members += other.members
        if self.least is None or (other.least is not None and other.least < self.least):
            self.least = other.least
        self.ends = self.ends or other.ends
        self.waiting += other.waiting
        self.asked = self.asked or other.asked


class _Item:
    """A sequence with sums at some depths of its path; a plain sequence has them at its end alone."""

    __slots__ = ("digests", "sizes", "sums")

    def __init__(self, digests: bytes, sizes: list[int], sums: dict[int, _Sum]):
        self.digests, self.sizes, self.sums = digests, sizes, sums


def _common(a: bytes, b: bytes) -> int:
    """How many digests two sequences share from the start."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    low, high = 0, most
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid)
    return low


def _key(digests: bytes, depth: int) -> bytes:
    return hashlib.blake2b(digests[: depth * WIDTH], digest_size=16).digest()


class _Forest:
    """Unites sorted items. Finished nodes are columns; `spines` are what is left open."""

    def __init__(self, items: list[_Item], last: bool):
        self.nodes: dict[str, list] = {name: [] for name in (*_NODE, "ends", "key", "parent_key")}
        self.items, self.open = items, set() if last else {0, len(items) - 1}
        self.up = list(range(len(items)))
        self.spines = []
        edges = np.array([_common(a.digests, b.digests) for a, b in zip(items, items[1:])], dtype=np.int64)
        far = None  # the last item's spine below the place where it leaves the first one's
        for k in np.argsort(-edges, kind="stable").tolist():
            depth, a, b = int(edges[k]), self._root(k), self._root(k + 1)
            if a in self.open and b in self.open:
                shared = {d: s for d, s in items[b].sums.items() if d <= depth}
                far = _Item(items[b].digests, items[b].sizes, {d: s for d, s in items[b].sums.items() if d > depth})
                self._put(items[a], shared)
                self.open.discard(b)
            else:
                if b in self.open:
                    a, b = b, a
                if a not in self.open:
                    self._lift(items[a], depth)
                self._lift(items[b], depth)
                self._put(items[a], items[b].sums)
            items[b].sums = {}
            self.up[b] = a
        if last:
            self._lift(items[self._root(0)], -1)
        else:
            self.spines = [items[0]] if far is None else [items[0], far]
            for item in self.spines:
                self._leave_open(item)

    def _root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    @staticmethod
    def _put(item: _Item, sums: dict[int, _Sum]) -> None:
        for depth, more in sums.items():
            if depth in item.sums:
                item.sums[depth].add(more)
            else:
                item.sums[depth] = more

    def _lift(self, item: _Item, until: int) -> None:
        """Write the nodes of a component from its top down to depth until + 1; what they add up to is put at depth until."""
        stops = [*sorted((d for d in item.sums if d > until), reverse=True), until]
        for depth, bottom in zip(stops, stops[1:]):  # nodes in between have one child and the same members
            now = item.sums.pop(depth)
            span = depth - bottom
            out, first = self.nodes, len(self.nodes["depth"])
            for row in now.waiting:
                out["parent_conv_id"][row] = now.least
            leaves, step = (now.leaves if now.children else 1), now.members - 1
            saved = np.cumsum(np.array([*reversed(item.sizes[max(bottom, 0) : depth]), *([0] if bottom < 0 else [])], dtype=np.int64) * step) + now.saved
            out["conv_id"] += [now.least] * span
            out["depth"] += range(depth, bottom, -1)
            out["parent_conv_id"] += [now.least] * (span - 1) + [None]
            out["n_convs"] += [now.members] * span
            out["n_children"] += [now.children] + [1] * (span - 1)
            out["n_leaves"] += [leaves] * span
            out["saved_tokens"] += saved.tolist()
            out["ends"] += [now.ends or _NONE_ENDS] + [_NONE_ENDS] * (span - 1)
            out["key"] += [_key(item.digests, depth) if now.asked else None] + [None] * (span - 1)
            out["parent_key"] += [None] * span
            if bottom < 0:
                return
            self._put(item, {bottom: _Sum(1, leaves, int(saved[-1]), now.members, now.least, None, [first + span - 1])})

    def _leave_open(self, item: _Item) -> None:
        """Finished children of open nodes name them by a key; the node itself will be written with it."""
        for depth, found in item.sums.items():
            if found.waiting:
                key, found.asked = _key(item.digests, depth), True
                for row in found.waiting:
                    self.nodes["parent_key"][row] = key
                found.waiting = []


def _node_rows(nodes: dict[str, list]) -> pa.Table | None:
    n = len(nodes["depth"])
    if not n:
        return None
    columns = {f"node_{name}": nodes[name] for name in _NODE} | {"node_ends": nodes["ends"], "node_key": nodes["key"], "parent_key": nodes["parent_key"]}
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _spine_rows(spines: list[_Item], number: int) -> pa.Table:
    rows = []
    for side, item in enumerate(spines):
        depths = sorted(item.sums)
        at = [item.sums[d] for d in depths]
        rows.append({"range": number, "side": side, "digests": item.digests, "sizes": item.sizes, "depth": depths, "ends": [s.ends for s in at], "asked": [s.asked for s in at]}
                    | {name: [getattr(s, name) for s in at] for name in _SUMS[1:]})
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _items(rows: Iterable[dict]) -> Iterator[_Item]:
    for r in rows:
        sums = {d: _Sum(*[r[name][k] for name in _SUMS[1:]], ends=r["ends"][k], asked=r["asked"][k]) for k, d in enumerate(r["depth"])}
        yield _Item(r["digests"], r["sizes"], sums)


def _unite(items: Iterator[_Item], number: int, last: bool) -> Iterator[pa.Table]:
    """Unite sorted items block by block; the spines of a block stand before the items of the next one."""
    spines: list[_Item] = []
    block, turns = [], 0
    item = next(items, None)
    while item is not None:
        block.append(item)
        turns += 1 + len(item.sizes)
        item = next(items, None)
        if item is None or turns >= BLOCK_TURNS:
            forest = _Forest(spines + block, last and item is None)
            rows = _node_rows(forest.nodes)
            if rows is not None:
                yield rows
            spines, block, turns = forest.spines, [], 0
    if spines:
        yield _spine_rows(spines, number)


def _unite_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sequences() -> Iterator[_Item]:
        for batch in batches:
            names = ("digests", "sizes", "members", "least", "ends")
            for digests, sizes, members, least, ends in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                yield _Item(digests, sizes, {len(sizes): _Sum(members=members, least=least, ends=ends)})

    for table in _unite(sequences(), TaskContext.get().partitionId(), False):
        yield from table.to_batches()


def _merger(last: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["range"], r["side"]))
        return pa.concat_tables(_unite(_items(rows), key[0].as_py(), last))

    return merge


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) to (key, first id, the ids as text) of bounded runs."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        cuts = [c for a, b in zip(starts, [*starts[1:], len(keys)]) for c in range(a, b, CHUNK_IDS)]
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
        yield pa.RecordBatch.from_arrays([pa.array([keys[c] for c in cuts], pa.binary()), pa.array([ids[c] for c in cuts], pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "ids"])


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (key, SHA-256 of all its ids); only the hash of the key at hand is held."""
    at, digest = None, None
    for batch in batches:
        keys, out = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != at:
                if at is not None:
                    keys.append(at)
                    out.append(digest.hexdigest())
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends"])


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns (an array of d, the hexadecimal digest of role and text, and n, the text's bytes) of each conversation.

    turns has conv_id, turn, role and text. Turns are in the order of turn, null first, ties by role and digest. Null roles and texts are
    empty; repeated rows are turns each; rows without conv_id belong to no conversation; other columns are not read. A conversation's digests
    (about 80 bytes a turn) are one row, its texts are not.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def graft_heads(sequences: DataFrame, group: int = 5, longest: int = 8) -> DataFrame:
    """Each conversation begins with the first h turns of conversation c - c % group, h = crc32(c) % (longest + 1), in place of its own first h.

    c % group is not negative for negative ids either. A head that is absent gives no turns; one that is short gives all it has.
    """
    h = F.pmod(F.crc32(F.col("c.conv_id").cast("string")), F.lit(longest + 1)).cast("int")
    heads = sequences.where(F.col("conv_id") % group == 0).select("conv_id", F.slice("turns", 1, longest).alias("turns"))
    own = F.col("c.turns")
    empty = F.slice(own, 1, 0)
    both = sequences.alias("c").join(heads.alias("p"), F.col("c.conv_id") - F.pmod("c.conv_id", F.lit(group)) == F.col("p.conv_id"), "left")
    rest = F.slice(own, h + 1, F.greatest(F.size(own), F.lit(1)))
    return both.select("c.conv_id", F.concat(F.slice(F.coalesce("p.turns", empty), F.lit(1), h), rest).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    sequences come from turn_sequences or graft_heads; conv_id must be unique. Sequences without turns end at the root; no sequences give no
    rows; sequences of any length count whole.
    """
    spark = sequences.sparkSession
    digests = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    flat = cut_lineage(sequences.select("conv_id", digests.alias("digests"), F.transform("turns", lambda t: t["n"]).alias("sizes")))
    key: Column = F.unhex(F.md5("digests")).alias("key")
    ids = flat.select(key, "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ids.mapInArrow(_hash_chunks, "key binary, first long, ids string")
    ends = chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_runs, "key binary, ends string")
    distinct = flat.groupBy("digests", "sizes").agg(F.count("*").alias("members"), F.min("conv_id").alias("least")).select("*", key).join(ends, "key").drop("key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, "digests").sortWithinPartitions("digests")
    found = cut_lineage(ranged.mapInArrow(_unite_range, _DDL))
    nodes = found.where("node_depth is not null")
    while True:
        last, spines = parts <= FOREST, found.where("node_depth is null")

        found = cut_lineage(spines.groupBy(F.floor(F.col("range") / FOREST).alias("forest")).applyInArrow(_merger(last), _DDL))
        nodes = nodes.unionByName(found.where("node_depth is not null"))
        parts = -(-parts // FOREST)
        if last:
            break
    parents = nodes.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("node_conv_id").alias("parent"))
    parents = F.broadcast(parents) if parents.count() <= MOST_BROADCAST else parents
    return nodes.join(parents, "parent_key", "left").select(
        F.col("node_conv_id").alias("conv_id"), F.col("node_depth").alias("depth"), F.coalesce("node_parent_conv_id", "parent").alias("parent_conv_id"),
        *[F.col(f"node_{name}").alias(name) for name in _NODE[3:]], F.col("node_ends").alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with the heads of their group's first conversation; see turn_sequences, graft_heads, prefix_trie."""
    return prefix_trie(graft_heads(cut_lineage(turn_sequences(turns))))
