import numpy as np
import pytest
from test_simhash import brute_prints

from sourceloom.llm import near_duplicates


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def kept_by_all_pairs(rows):
    """The smallest id of each component of pairs at a Jaccard similarity of 0.8 or more."""
    sets, label = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {}
    for r, root in zip(rows, label):
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    return sorted(least.values())


def test_kept_are_those_of_all_pairs(sample, edge_docs, empty_docs):
    rows = sample.collect()
    kept = near_duplicates.drop_similar(sample)
    assert kept.columns == sample.columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_all_pairs(rows)
    assert near_duplicates.drop_similar(sample.union(sample)).count() == len(kept_by_all_pairs(rows))
    left = near_duplicates.drop_similar(edge_docs)
    assert left.columns == edge_docs.columns
    texts = [r.text for r in left.collect()]
    assert texts.count("same text here") == 1 and sum(not (t or "").strip() for t in texts) == 1
    assert near_duplicates.drop_similar(empty_docs).collect() == []


def chained(n_words, shared, steps, name):
    """Texts that follow one another by a window over one long text."""
    words = [f"{name}{k}" for k in range(n_words + steps * (n_words - shared))]
    return [" ".join(words[k * (n_words - shared) :][:n_words]) for k in range(steps + 1)]


def test_fingerprints_are_majorities(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 255, 256, 1000)]
    prints, unsure = near_duplicates.set_fingerprints(sets)
    for hashes, got, places in zip(sets, prints, unsure):
        margins = []
        for word in range(16):
            mixed = near_duplicates._mix(hashes * near_duplicates._ODD[0, word] + near_duplicates._ODD[1, word]).tolist()
            margins += [2 * sum(h >> b & 1 for h in mixed) - len(mixed) for b in range(64)]
        assert sum((m > 0) << k for k, m in enumerate(margins)) == int.from_bytes(got.tobytes(), "little")
        for k in range(22):
            near = [abs(m) for m in margins[23 * k : 23 * k + 23]]
            assert sorted(near[p] for p in places[k]) == sorted(near)[:4]
    keys = near_duplicates.segment_keys(prints, unsure)
    assert keys.shape == (6, 110) and all(len(set(k.tolist())) == 110 for k in keys)


def test_shared_sizes():
    rng = np.random.default_rng(3)
    sets = np.empty(20, object)
    sets[:] = [np.unique(rng.integers(-30, 30, rng.integers(1, 40))) for _ in range(20)]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(20) for b in range(20)]))
    assert near_duplicates._shared_sizes(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_pairs_at_the_similarity_meet():
    """Of pairs at 0.8, over 0.97 meet in some segment, and nearly all are within the distance."""
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(1000)]
    (a, p), (b, q) = (near_duplicates.set_fingerprints([np.sort(w[s]) for w in words]) for s in (slice(0, 90), slice(10, 100)))
    meet = [bool(set(x) & set(y)) for x, y in zip(near_duplicates.segment_keys(a, p).tolist(), near_duplicates.segment_keys(b, q).tolist())]
    assert np.mean(meet) > 0.97
    assert np.mean(np.bitwise_count(a ^ b).sum(axis=1) <= near_duplicates.MOST_BITS) > 0.995


@pytest.mark.parametrize("block", [2048, 2])
def test_similarity_decides(spark, monkeypatch, block):
    """Chains at 0.8, pairs just below, and pairs whose fingerprints mislead."""
    monkeypatch.setattr(near_duplicates, "KEY_BLOCK", block)
    texts = chained(94, 84, 12, "a") + chained(93, 82, 12, "b")  # 80 of 100 and 78 of 100 shingles shared
    texts += [" ".join(f"c{k}" for k in range(30)) + " x" * 400, " ".join(f"c{k}" for k in range(30)) + " x" * 9]  # equal sets
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = kept_by_all_pairs(rows.collect())
    assert expected == [0, *range(13, 26), 26]
    assert sorted(r.doc_id for r in near_duplicates.drop_similar(rows).collect()) == expected
    far = [brute_prints(t, 5, (42, 43)) for t in texts[-2:]]  # fingerprints of repeated shingles are far apart
    assert sum((a ^ b).bit_count() for a, b in zip(*far)) > 22


def test_small_sets_are_linked_exactly(spark):
    """Texts of 8 to 18 words, one word added at an end: pairs at exactly 0.8 and above are linked, those below are not."""
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        n = 8 + k % 11
        words = [f"w{x}" for x in rng.integers(0, 10**9, n + 3)]
        more = 1 + k % 3
        rows += [(2 * k, " ".join(words[:n])), (2 * k + 1, " ".join(words[: n + more]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_duplicates.drop_similar(df)
    expected, found = kept_by_all_pairs(df.collect()), sorted(r.doc_id for r in kept.collect())
    small = {2 * k + 1 for k in range(300) if 8 + k % 11 - 4 < near_duplicates.SMALL}
    assert [d for d in found if d in small] == [d for d in expected if d in small]
    assert set(expected) <= set(found) and len(found) - len(expected) <= 0.1 * (600 - len(expected))


def test_lower_similarities_are_refused(sample):
    with pytest.raises(ValueError):
        near_duplicates.drop_similar(sample, similarity=0.5)
