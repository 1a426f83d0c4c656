import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from tokenizers import Tokenizer

from sourceloom.llm import byte_bpe, packing, pretokens, token_counts

PARTS = [
    " ", "\n", "'s", "'re", "'ll", "'v", "the", "an", "é", "日本", "1", "22", "!!", "...", "<|endoftext|>", "<|endo", "ing", "er", "aaaa", "zq",
    "😀", "  ", "\t", "A", "HTTP", "\x85", "\xa0", "=====", "́", "Σ", "İ", "\x1c", " ", "</w>", "ß",
]


def texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 3000, "é" * 2000, ""]


def test_borders_are_those_of_the_pattern():
    pattern = regex.compile(P.PATTERN)
    table = pretokens.unpacked(pretokens.tiktoken_classes())
    for text, got in zip(texts(), pretokens.split_texts(texts(), table)):
        assert got == pattern.findall(text)


def test_chunk_maps_compose_to_the_sequential_run():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, pretokens.N_CLASSES, 5000).astype(np.uint8)
    for chunk in (1, 7, 256, 8192):
        assert (pretokens.borders(classes) == _borders(classes, chunk)).all()


def _borders(classes, chunk):
    states, grid = pretokens.scan_states(classes, chunk)
    bits = pretokens.machine()[1][states * np.uint8(12) + grid].T.ravel()[: len(classes)]
    at = (bits & 1).astype(bool)
    at[:-1] |= (bits[1:] & 2).astype(bool)
    return np.flatnonzero(at)


def test_transducer_counts_as_the_library():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = token_counts.counter(P.path("byte_bpe_50k.json"), pretokens.tokenizers_classes())
    assert count(texts()) == [len(x.ids) for x in library.encode_batch(texts(), add_special_tokens=False)]


def test_bounded_states_do_not_change_counts(monkeypatch):
    machine = token_counts.load_transducer(P.path("byte_bpe_50k.json"))[0]
    words = [("wordsandmore" * 9)[k:] for k in range(60)]
    expected = [machine.count(w.encode()) for w in words]
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    assert [machine.count(w.encode()) for w in words] == expected


def test_token_counts_of_edge_rows(edge_docs, empty_docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for row in token_counts.token_counts(edge_docs).collect():
        text = {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None}.get(row.doc_id)
        if row.doc_id is not None:
            assert row.n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
            assert row.n_bytes == len((text or "").encode()) and row.over_limit == (row.n_tokens > 512)
    assert token_counts.token_counts(edge_docs).count() == edge_docs.count()
    assert token_counts.token_counts(empty_docs).collect() == []


def test_perfect_hash_is_minimal():
    keys = [f"key{k}".encode() for k in range(2000)]
    found = byte_bpe.PerfectHash(keys)
    assert sorted(found.lookup(keys).tolist()) == list(range(2000))
    assert found.lookup([b"other", b""]).tolist() == [-1, -1]


def test_encoding_is_that_of_the_library():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec, table = byte_bpe.load_codec(path), pretokens.unpacked(pretokens.tiktoken_classes())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text, ids in zip(texts(), codec.encode(texts(), table)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_of_edge_rows(edge_docs, empty_docs):
    rows = byte_bpe.bpe_encode(edge_docs).collect()
    text = {r.doc_id: r.text for r in edge_docs.collect()}
    assert len(rows) == edge_docs.count()
    assert all(bytes(r.decoded) == (text[r.doc_id] or "").encode() and r.n_tokens == len(r.ids) for r in rows if r.doc_id is not None)
    digests = {r.doc_id: r for r in byte_bpe.bpe_digests(edge_docs).collect()}
    for r in rows:
        if r.doc_id is not None:
            assert digests[r.doc_id].ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert byte_bpe.bpe_encode(empty_docs).collect() == []


def test_words_encode_as_whole_texts():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    for text, ids in zip(texts(), own.encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(docs, pieces, capacity=4096):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc.pop(doc.doc_id), key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert (p.start, list(p.ids), p.doc_tokens) == (at, part, len(ids)) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_places_every_id_once(sample, monkeypatch):
    docs = sample.collect()
    n = check_packing(docs, packing.pack_sequences(sample).collect())
    total = sum(p.length for p in packing.pack_sequences(sample).collect())
    assert n <= 1.2 * total / 4096 + 2
    monkeypatch.setattr(packing, "FAN_IN", 2)  # several rounds of merging
    check_packing(docs, packing.pack_sequences(sample.repartition(7), most_open=3).collect())


def test_packing_of_edge_rows(edge_docs, empty_docs):
    unique = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(unique.collect(), packing.pack_sequences(unique).collect())
    assert packing.pack_sequences(edge_docs).where("start = 0").count() == edge_docs.count()
    assert packing.pack_sequences(empty_docs).collect() == []


def test_assembled_sequences_are_full_length(sample):
    rows = packing.assemble_sequences(packing.pack_sequences(sample)).collect()
    assert all(len(r.ids) == 4096 and r.n_ids <= 4096 for r in rows)
