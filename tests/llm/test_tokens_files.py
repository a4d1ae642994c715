"""Packing and token files: exact round trips against the tokenizer
library."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gramloom.llm import huffman, packing
from gramloom.llm.tokens import Encoder, default_tokenizer
from tests.llm.data import awkward, documents, empty, texts


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tok, text, end):
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_library_with_a_tiny_memo(tok):
    enc = Encoder(default_tokenizer(), memo_items=20)
    some = [t or "" for t in texts(3)] + ["It's <|endoftext|> ok", "don't 's 12.5%!! Ünïcode ªº²", "a\x1cb\x85c\xa0d e"]
    for lo in range(0, len(some), 4):
        got = enc.encode(some[lo:lo + 4])
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [
            tok.encode(t, add_special_tokens=False).ids for t in some[lo:lo + 4]]


def test_pack_covers_every_id_once(spark, tok):
    df = awkward(spark)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, ids_of(tok, r["text"], 2)) for r in df.collect())
    rows = packing.pack(df, window=128).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            stream.append(r)
        assert at == 128 or s == len(by_sequence) - 1
    got, cur = [], []
    for r in stream:
        assert r["start"] == len(cur)
        cur += np.frombuffer(r["ids"], "<u4").tolist()
        if len(cur) == r["doc_tokens"]:
            got.append((r["doc_id"] is not None, r["doc_id"] or 0, cur))
            cur = []
    assert not cur and sorted(got) == want


def test_sequences_join_boundary_records(spark):
    packed = packing.pack(awkward(spark, 1), window=64)
    want = defaultdict(bytes)
    for r in packed.orderBy("sequence_id", "offset").collect():
        want[r["sequence_id"]] += r["ids"]
    rows = packing.sequences(packed, 64).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in rows} == dict(want) and len(rows) == len(want)


def test_sequences_of_an_empty_table(spark):
    assert packing.sequences(packing.pack(empty(spark))).count() == 0


def test_token_files_hold_ids_and_are_read_in_splits(spark, tok, monkeypatch):
    """Every file alone gives its documents; splits start between documents."""
    monkeypatch.setattr(huffman, "SECTION", 50)
    monkeypatch.setattr(huffman, "SPLIT", 200)
    df = awkward(spark, 4)
    manifest = huffman.write_ids(df, block=16)
    files = [r["file"] for r in manifest.select("file").distinct().collect()]
    assert manifest.count() > len(files)
    got = [(d is not None, d or 0, ids.tolist()) for f in sorted(files) for d, ids in huffman.read_file(f)]
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, ids_of(tok, r["text"], 1)) for r in df.collect())
    assert sorted(got) == want and [g[:2] for g in got] == [w[:2] for w in want]
    rows = huffman.read_ids(manifest).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [g[2] for g in got]
    assert [r["doc_id"] for r in rows] == [d if known else None for known, d, _ in got]


def test_empty_tables(spark):
    assert packing.pack(empty(spark)).count() == 0
    assert huffman.read_ids(huffman.write_ids(empty(spark))).count() == 0


def test_huffman_files_round_trip(spark, tok):
    df = awkward(spark, 2)
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), ids_of(tok, r["text"], 1)) for r in df.collect())
    rows = huffman.read_ids(huffman.write_ids(df, block=16)).orderBy("start").collect()
    at, keys = 0, []
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
        keys.append((r["doc_id"] is not None, r["doc_id"] or 0))
    assert keys == sorted(keys)
    assert sorted((k, np.frombuffer(r["ids"], "<u4").tolist()) for k, r in zip(keys, rows)) == want


@pytest.mark.parametrize("seed", range(6))
def test_huffman_code_is_limited_and_decodes(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 2000))
    counts = {int(s): int(2.0 ** rng.integers(0, 40)) for s in rng.permutation(5000)[:k]}
    lengths = huffman.code_lengths(counts, 12)
    assert max(lengths.values()) <= 12 and sum(2.0 ** -n for n in lengths.values()) <= 1
    table = np.zeros(5000, np.uint8)
    for s, n in lengths.items():
        table[s] = n
    ids = rng.choice(list(counts), 3001)
    marks, payload = huffman.pack_bits(ids, huffman.canonical(table), table, 32)
    sym, size = huffman.decode_table(table)
    assert (huffman.unpack_bits(payload, marks, len(ids), 32, sym, size) == ids).all()


def test_package_merge_is_optimal_without_a_limit():
    import heapq
    counts = {0: 5, 1: 9, 2: 12, 3: 13, 4: 16, 5: 45}
    heap = [(n, {s: 0}) for s, n in counts.items()]
    heap = [(n, i, d) for i, (n, d) in enumerate(heap)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, i, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        heapq.heappush(heap, (a + b, i, {k: v + 1 for k, v in (x | y).items()}))
    best = sum(counts[s] * n for s, n in heap[0][2].items())
    assert sum(counts[s] * n for s, n in huffman.code_lengths(counts).items()) == best


def test_long_document_spans_sections(spark, tok, monkeypatch):
    monkeypatch.setattr(huffman, "SECTION", 100)
    df = documents(spark, ["word " * 1000, "x", "y " * 99])
    rows = huffman.read_ids(huffman.write_ids(df)).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [
        ids_of(tok, t, 1) for t in ("word " * 1000, "x", "y " * 99)]
