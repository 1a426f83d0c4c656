import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourceloom.llm import collocations as co
from sourceloom.llm import prefix_trie as pt
from sourceloom.llm.mixing import mix_sources, solve_rates, source_targets

UPPER = {k: k + 32 for k in range(65, 91)}


# prefix trie

def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return nodes_of({c: tuple(own.get(c - c % 5, [])[: head[c]] + turns[head[c]:]) for c, turns in own.items()})


def nodes_of(sequences):
    members, children, ends = {}, {}, {}
    for conv in sorted(sequences):
        turns = sequences[conv]
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
        ends.setdefault(turns, []).append(conv)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(node, ())]
        size = len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * size)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(children.get(n, ())), *sums[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n, m in members.items())


def trie_rows(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("parts", ["3", "70"])
def test_trie_matches_brute_force(spark, sf_dir, parts):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # 70 ranges: two rounds of merging
    try:
        assert trie_rows(pt.conversation_trie(turns)) == brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(40) for t in range(3)] + [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "hello 1"), (7, 1, "bot", "tie")]
    rows += [(101, t, "user", "long " * 20_000 if t == 5 else "x") for t in range(30)] + [(-3, 0, None, "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int")
    # brute force breaks ties by text, the operator by digest: here the tie is of two roles
    assert trie_rows(pt.conversation_trie(df)) == brute_trie(rows)
    assert pt.conversation_trie(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=40), st.integers(1, 12), st.integers(1, 4))
def test_forests_in_any_blocks(lists, block, ranges):
    """Blocks of any size and ranges merged in two rounds give the nodes of one trie."""
    spell = lambda seq: b"".join(bytes([k]) * pt.WIDTH for k in seq)
    sequences = {c: tuple((str(k), "x" * k) for k in seq) for c, seq in enumerate(lists)}
    groups = {}
    for conv, seq in enumerate(lists):
        groups.setdefault(tuple(seq), []).append(conv)
    items = []
    for seq in sorted(groups, key=spell):
        ends = hashlib.sha256(",".join(map(str, groups[seq])).encode()).hexdigest()
        items.append(pt._Item(spell(seq), list(seq), {len(seq): pt._Sum(members=len(groups[seq]), least=min(groups[seq]), ends=ends)}))
    before, pt.BLOCK_TURNS = pt.BLOCK_TURNS, block
    try:
        found, spines = [], []
        step = -(-len(items) // ranges)
        for k in range(0, len(items), step):
            out = [r for t in pt._unite(iter(items[k : k + step]), k, False) for r in t.to_pylist()]
            spines += [r for r in out if r["node_depth"] is None]
            found += [r for r in out if r["node_depth"] is not None]
        found += [r for t in pt._unite(pt._items(sorted(spines, key=lambda r: (r["range"], r["side"]))), 0, True) for r in t.to_pylist()]
    finally:
        pt.BLOCK_TURNS = before
    least = {r["node_key"]: r["node_conv_id"] for r in found if r["node_key"]}
    rows = []
    for r in found:
        parent = r["node_parent_conv_id"] if r["node_parent_conv_id"] is not None else least.get(r["parent_key"], -1)
        rows.append((r["node_conv_id"], r["node_depth"], parent, *(r[f"node_{n}"] for n in pt._NODE[3:]), r["node_ends"]))
    assert sorted(rows) == nodes_of(sequences)


# collocations

def brute_phrases(rows, least, share, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = {q[i : i + m] for q, f in candidates.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * f >= share * own[q[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, share, top", [(30, 80, 2000), (3, 50, 40)])
def test_collocations_match_brute_force(spark, sample, monkeypatch, least, share, top):
    rows = [(r.lang, r.text) for r in sample.collect()]
    found = co.collocations(sample.repartition(3), least=least, share=share, top=top)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, share, top)


def test_collocation_edges(spark, edge_docs, empty_docs):
    rows = [(r.lang, r.text) for r in edge_docs.collect()]
    assert sorted(map(tuple, co.collocations(edge_docs, least=2).collect())) == brute_phrases(rows, 2, 80, 2000)
    assert co.collocations(empty_docs).count() == 0
    odd = [("a\nb", "x y. x y! X\tY\x0bx y"), (None, "x y z " * 50), ("", "É é\x1cé É é\x1cé"), ("und", "x y z"), ("a\nb", None)]
    df = spark.createDataFrame(odd, "lang string, text string")
    assert sorted(map(tuple, co.collocations(df, least=2).collect())) == brute_phrases(odd, 2, 80, 2000)


def test_collocations_of_hundreds_of_tasks(spark):
    """Numbers of words have room for the numbers of all tasks."""
    df = spark.range(0, 300, 1, 300).selectExpr("'en' as lang", "concat('a b c', id % 7, ' d e', id % 3) as text")
    assert sorted(map(tuple, co.collocations(df, least=3).collect())) == brute_phrases([(r.lang, r.text) for r in df.collect()], 3, 80, 2000)


def test_packed_rows_are_summed_whole():
    """Rows of shards meet in their buckets, negative numbers and sums included, in few bytes each."""
    rng, total, tables, size = np.random.default_rng(1), Counter(), [], 0
    for shard in (5, 9, 1 << 40):
        words = np.minimum(rng.zipf(1.3, (60_000, 2)), 1 << 15) + (7 << 27)
        pairs, n = np.unique(words, axis=0, return_counts=True)
        total.update(dict(zip(map(tuple, pairs.tolist()), n.tolist())))
        tables.append(co._packed(shard, [*pairs.T, n], 3))
        size += sum(map(len, tables[-1]["data"].to_pylist()))
    packed, found = pa.Table.from_batches(tables), {}
    for k in range(3):
        rows, _, first, f = co._summed(packed.filter(pc.equal(packed["bucket"], k)), 2)
        found |= dict(zip(map(tuple, rows[:2, first].T.tolist()), f.tolist()))
    assert found == total and size < 5 * sum(packed["n_rows"].to_pylist())
    odd = np.array([[-(1 << 63), -1, 0, (1 << 63) - 1], [3, -1, 7, -(1 << 62)], [1, 2, 3, 1 << 40]], np.int64)
    assert (co._unpack_rows(3, 4, co._pack_rows(odd)) == odd).all()


def test_frequent_bigrams_go_back_packed():
    """A bucket has a row for its frequent bigrams and one for each shard that holds some, however many they are."""
    rng, total, own, tables = np.random.default_rng(2), Counter(), {}, []
    for shard in (0, 3, 1 << 40):
        words = np.minimum(rng.zipf(1.2, (60_000, 2)), 3000 if shard else 1 << 15)
        pairs, n = np.unique(words, axis=0, return_counts=True)
        own[shard] = set(map(tuple, pairs.tolist()))
        total.update(dict(zip(map(tuple, pairs.tolist()), n.tolist())))
        tables.append(co._packed(shard, [*pairs.T, n], 3))
    tables.append(co._packed(7, [np.array([5]), np.array([1 << 30]), np.array([1])], 3))  # a shard of no frequent one
    packed, counts, found, n_rows = pa.Table.from_batches(tables), {}, {shard: set() for shard in own}, 0
    for k in range(3):
        out = co._frequent_bigrams(4)(packed.filter(pc.equal(packed["bucket"], k)))
        n_rows += out.num_rows
        for shard, n, data in zip(*(out[c].to_pylist() for c in ("shard", "n_rows", "data"))):
            rows = co._unpack_rows(3, n, data)
            if shard is None:
                counts |= dict(zip(map(tuple, rows[:2].T.tolist()), rows[2].tolist()))
            else:
                found[shard] |= set(map(tuple, rows[:2].T.tolist()))
    frequent = {pair: f for pair, f in total.items() if f >= 4}
    assert counts == frequent and found == {shard: pairs & frequent.keys() for shard, pairs in own.items()}
    assert n_rows == 3 * 4 and len(frequent) > 1000
    assert co._frequent_bigrams(1 << 40)(packed.filter(pc.equal(packed["bucket"], 0))).num_rows == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120))
def test_index_counts_all_phrases(ids):
    """Both directions of extension count what a plain count of windows counts."""
    ids = np.array([0, *ids, 0], np.int64)
    windows = lambda k: Counter(tuple(w) for w in (ids[i : i + k].tolist() for i in range(len(ids) - k + 1)) if 0 not in w)
    first, second, n = co._bigrams(ids)
    assert {(a, b): c for a, b, c in zip(first.tolist(), second.tolist(), n.tolist())} == windows(2)
    phrases, n = co._longer(ids)
    assert {tuple(w for w in p if w): c for p, c in zip(phrases.tolist(), n.tolist())} == windows(3) | windows(4)


def test_shards_of_any_size(spark, sample, monkeypatch):
    """Shards end where a piece ends, so their size changes no count."""
    rows = [(r.lang, r.text) for r in sample.limit(60).collect()]
    monkeypatch.setattr(co, "SHARD_WORDS", 500)
    words = Counter()

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(co, "TaskContext", Context)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    shards = [r for b in co._write_shards(iter([batch])) for r in b.to_pylist()]
    assert len(shards) > 8 and len({r["shard"] for r in shards}) == len(shards)
    for r in shards:
        words.update({(r["lang"], w): n for w, n in zip(r["words"], r["counts"])})
        assert np.bincount(co._unpack(r["n_ids"], r["ids"]))[1:].tolist() == r["counts"]
    expected = Counter((lang, w) for lang, text in rows for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", text.translate(UPPER)))
    assert words == expected


# mixing

def test_mix_meets_its_targets(spark, sample):
    found = [r.asDict() for r in mix_sources(sample).collect()]
    size = {}
    for r in found:
        size.setdefault(r["source"], []).append(r)
    total, ordered = sum(r["size"] for r in found), sorted(size)
    weight = {s: 1 + k % 3 for k, s in enumerate(ordered)}
    whole = {s: sum(r["size"] for r in size[s]) for s in ordered}
    shut = set()
    while True:
        level = (total - sum(3 * whole[s] for s in shut)) / max(1, sum(weight[s] for s in ordered if s not in shut))
        more = {s for s in ordered if 3 * whole[s] <= level * weight[s]} - shut
        if not more:
            break
        shut |= more
    for s, rows in size.items():
        target = 3 * whole[s] if s in shut else level * weight[s]
        assert {r["source_size"] for r in rows} == {whole[s]} and all(abs(r["target"] - target) <= 1e-6 * target for r in rows)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    assert len(found) == sample.count()


def test_mix_is_the_same_however_dealt(spark, sample):
    once = sorted(map(tuple, mix_sources(sample).collect()))
    assert once == sorted(map(tuple, mix_sources(sample.repartition(7, "text")).collect()))


def test_mix_edges(spark, edge_docs, empty_docs):
    assert mix_sources(empty_docs.withColumnRenamed("component_id", "source")).count() == 0
    df = edge_docs.drop("lang").withColumnRenamed("component_id", "source").selectExpr("*", "1 as copies", "'x' as target")
    assert {r.source for r in mix_sources(df).collect()} == {"z", None} and mix_sources(df).count() == df.count()
    # a source at its limit, one without words, a null source, and many equal rows
    rows = [(1, "a b", "tiny"), (2, None, "none")] + [(3, "w " * 40, "same")] * 60 + [(k, "v " * k, None) for k in range(100, 160)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    tiny = [r for r in found if r.source == "tiny"]
    assert [(r.target, r.taken) for r in tiny] == [(6.0, 6)]
    assert {(r.target, r.taken) for r in found if r.source == "none"} == {(0.0, 0)}
    for source in ("same", None):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 160
    assert abs(sum(r.taken for r in found) - sum(r.size for r in found)) <= 320


def test_rates_are_the_duals_root(spark):
    rows = [("a", n, 7 + n % 5) for n in range(1, 60)] + [("b", 5000, 1), ("b", 3, 1000)]
    cells = spark.createDataFrame(rows, "source string, size long, count long")
    sources = cells.groupBy("source").agg({"size": "max"}).selectExpr("source", "cast(0 as long) as source_size")
    whole = {s: sum(n * c for x, n, c in rows if x == s) for s in ("a", "b")}
    for share in (0.01, 1.0, 2.9):
        targets = spark.createDataFrame([(s, whole[s], share * whole[s]) for s in whole], "source string, source_size long, target double")
        for source, multiplier in solve_rates(cells, targets).collect():
            taken = sum(n * c * min(3.0, (n + 1) ** (multiplier / np.log(2))) for x, n, c in rows if x == source)
            assert abs(taken - share * whole[source]) <= (2e-6 * share + 2.0 ** -22) * whole[source]
    assert source_targets(sources).where("target <> 0").count() == 0
