import numpy as np
import xxhash

from sourceloom.llm import simhash
from sourceloom.llm.components import connected_components


def brute_prints(text, words, seeds):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    out = []
    for seed in seeds:
        hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def brute_components(rows, prints, radius):
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    bits = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = [find(k) for k in range(len(rows))]
    least = {}
    for k, root in enumerate(roots):
        if rows[k].doc_id is not None:
            least[root] = min(rows[k].doc_id, least.get(root, rows[k].doc_id))
    return [least.get(root) for root in roots]


def test_components_are_those_of_all_pairs(sample):
    rows = sample.collect()
    prints = [brute_prints(r.text, 3, (42,)) for r in rows]
    expected = {r.doc_id: ("%016x" % p[0], c) for r, p, c in zip(rows, prints, brute_components(rows, prints, 2))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(sample).collect()}
    assert got == expected


def test_near_links_lose_none_at_any_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            x = b
            for bit in rng.integers(0, 63, rng.integers(1, 7)).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    nodes = spark.createDataFrame([(v,) for v in values], "node long")
    bits = np.array(values, np.int64).view(np.uint64)
    for n_segments, radius in ((4, 3), (2, 2), (2, 5), (4, 7)):
        links = simhash.near_links(nodes, ["node"], n_segments, radius)
        got = {r.node: r.root for r in connected_components(links).collect()}
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
        label = np.arange(len(values))
        for _ in values:
            label = np.array([label[near[k]].min() for k in range(len(values))])
        assert [got.get(v, v) for v in values] == [values[k] for k in label]


def test_large_keys_are_searched_whole(monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 10, 300).astype(np.uint64)
    keys, nodes = np.zeros(300, np.int64), np.arange(300)
    apart = []
    for limit in (4096, 10):
        monkeypatch.setattr(simhash, "LARGE_KEY", limit)
        a, b = simhash._links_of_keys(keys, nodes, [words], 1)
        label = np.arange(300)
        for _ in range(300):
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
        apart.append(label.tolist())
    assert apart[0] == apart[1]


def test_edge_rows(edge_docs, empty_docs):
    rows = edge_docs.collect()
    got = simhash.simhash_components(edge_docs).collect()
    prints = [brute_prints(r.text, 3, (42,)) for r in rows]
    expected = sorted(map(str, zip([r.doc_id for r in rows], ["%016x" % p[0] for p in prints], brute_components(rows, prints, 2))))
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == expected
    assert simhash.simhash_components(empty_docs).collect() == []


def test_components_of_long_paths_are_whole(spark):
    links = spark.range(3000).selectExpr("(id * 7919) % 3001 as a", "((id + 1) * 7919) % 3001 as b")
    found = connected_components(links).collect()
    assert len(found) == 3001 and {r.root for r in found} == {0}
    assert connected_components(links.limit(0)).collect() == []
