"""Subword vocabulary laws: size bound, reserved ids, every character kept,
decode(encode(x)) = the normalised text, pieces hold the boundary mark only
at the start."""
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.operators import subword as SW
from gramloom.operators.vocab import decode_expr
from gramloom.sources.lines import corpus_lines

SF = "/root/testdata/sf0.001"


def test_unigram_vocab_and_roundtrip(spark):
    lines = corpus_lines(spark, SF)
    v = SW.train_unigram(lines, vocab_size=600, seed_factor=5).cache()
    rows = v.collect()
    assert len(rows) <= 600
    ids = sorted(r.id for r in rows)
    assert ids == list(range(len(rows)))
    assert [r.piece for r in sorted(rows, key=lambda r: r.id)[:3]] == [K.UNK_PIECE, *K.CONTROL_PIECES]
    pieces = {r.piece for r in rows}
    assert all(K.SPACE_MARK not in p[1:] for p in pieces)
    text = "".join(unicodedata.normalize("NFKC", r.line) for r in lines.collect())
    assert {ch for ch in text if not ch.isspace()} <= {p for p in pieces if len(p) == 1} | {K.SPACE_MARK}
    conv = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text")
    enc = SW.encode_subword(conv, ["conv_id", "turn"], "text", v)
    out = enc.select("text", decode_expr(F.col("ids_tok"), "subword").alias("dec"), "ids").collect()
    for r in out:
        assert r.dec == " ".join(unicodedata.normalize("NFKC", r.text).split())
        assert all(i >= 0 for i in r.ids)


def test_viterbi_prefers_likely_pieces():
    logp = {"▁ab": -1.0, "▁": -3.0, "a": -3.0, "b": -3.0, "▁a": -2.5}
    assert SW.viterbi("▁ab", logp, 16)[0] == ["▁ab"]
    assert SW.viterbi("▁ba", logp, 16)[0] == ["▁", "b", "a"]
    z, counts = SW.forward_backward("▁ab", logp, 16)
    assert abs(sum(len(p) * c for p, c in counts.items()) - 3) < 1e-9


def test_training_is_reproducible_across_partitionings(spark):
    lines = corpus_lines(spark, SF)
    a = [tuple(r) for r in SW.train_unigram(lines, vocab_size=300, seed_factor=4).orderBy("id").collect()]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = [tuple(r) for r in SW.train_unigram(lines, vocab_size=300, seed_factor=4).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_sample_is_exact_at_a_small_share(spark, seed):
    lines = spark.range(200_000).selectExpr("id div 10 as doc_id", "cast(id % 10 as int) as line_no", "'x' as line")
    got = SW.sample_lines(lines, 100, seed).collect()
    assert len(got) == len({(r.doc_id, r.line_no) for r in got}) == 100
    again = SW.sample_lines(lines.repartition(3), 100, seed).collect()
    assert sorted(got) == sorted(again)
    h = {k: int(hashlib.md5(f"{seed}-{k // 10}-{k % 10}".encode()).hexdigest()[:15], 16) for k in range(200_000)}
    assert {r.doc_id * 10 + r.line_no for r in got} == set(sorted(h, key=h.get)[:100])


def test_line_sample_of_few_lines(spark):
    lines = spark.range(7).selectExpr("id as doc_id", "0 as line_no", "'x' as line")
    assert [SW.sample_lines(lines, n).count() for n in (0, 1, 7, 9)] == [0, 1, 7, 7]


def test_too_small_a_vocabulary_is_an_error(spark):
    lines = spark.createDataFrame([("abcdefghijklmnopqrst uvw",)], "line string")
    with pytest.raises(ValueError, match="too small"):
        SW.train_unigram(lines, vocab_size=12)


def test_a_run_of_unknown_characters_is_one_id(spark):
    v = SW.train_unigram(spark.createDataFrame([("ab ab ba",)] * 3, "line string"), vocab_size=8)
    df = spark.createDataFrame([(1, "ab日本語ab 日"), (2, "")], "k int, t string")
    ids = {r.k: r.ids for r in SW.encode_subword(df, ["k"], "t", v).select("k", "ids").collect()}
    assert ids[2] == [] and ids[1].count(K.UNK_ID) == 2


def test_encoding_is_without_a_shuffle_and_memo_bound(spark, monkeypatch):
    """Whole texts where they lie; a tiny memo gives the same pieces."""
    lines = corpus_lines(spark, SF)
    v = SW.train_unigram(lines, vocab_size=400, seed_factor=4).cache()
    enc = SW.encode_subword(lines, ["doc_id", "line_no"], "line", v)
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Join" not in plan
    want = sorted((r.doc_id, r.line_no, r.ids) for r in enc.select("doc_id", "line_no", "ids").collect())
    monkeypatch.setattr(SW, "MEMO_CHUNKS", 3)
    logp = [(r.piece, r.score, r.id) for r in v.filter("id >= 3").collect()]
    seg = SW.Segmenter([p for p, _, _ in logp], [s for _, s, _ in logp], 16)
    ids = [K.UNK_ID, *(i for _, _, i in logp)]
    for r in lines.limit(200).collect():
        words = unicodedata.normalize("NFKC", r.line).split()
        got = [ids[k] for w in words for k in seg(K.SPACE_MARK + w)]
        assert (r.doc_id, r.line_no, got) in want
        assert len(seg.memo) <= 3


def test_encoding_of_null_empty_and_long_texts(spark):
    v = SW.train_unigram(spark.createDataFrame([("ab ab ba",)] * 3, "line string"), vocab_size=8)
    df = spark.createDataFrame([(1, None), (2, " \t"), (3, "ab" * 50000), (None, "ab")], "k int, t string")
    rows = {r.k: (r.ids, r.d) for r in SW.encode_subword(df, ["k"], "t", v)
            .select("k", "ids", decode_expr(F.col("ids_tok"), "subword").alias("d")).collect()}
    assert rows[1] == ([], "") and rows[2] == ([], "") and rows[3][1] == "ab" * 50000 and rows[None][1] == "ab"


def test_many_words_at_once_give_the_counts_and_losses_of_single_words():
    import random
    rnd = random.Random(5)
    words = ["▁" + "".join(rnd.choice("abcé𝄞") for _ in range(rnd.randint(1, 12))) for _ in range(300)] + ["▁zz", "▁"]
    pieces = sorted({w[i:j] for w in words[:200] for i in range(len(w)) for j in range(i + 1, min(len(w), i + 4) + 1)} - {"z", "é"})
    logp = {p: -rnd.uniform(1, 9) for p in pieces}
    freqs = [rnd.randint(1, 50) for _ in words]
    trie = SW.piece_trie(pieces, list(logp.values()))
    want = dict.fromkeys(pieces, 0)
    for w, f in zip(words, freqs):
        for p, c in SW.forward_backward(w, logp, 4)[1].items():
            want[p] += int(round(c * SW.FIXED_POINT)) * f
    assert dict(zip(pieces, SW.expected_counts(words, freqs, trie, 4).tolist())) == want
    got = SW.best_without_itself(pieces, trie, 4)
    for p, alt in zip(pieces, got):
        if len(p) > 1:
            assert alt == SW.viterbi(p, {q: x for q, x in logp.items() if q != p}, 4)[1]


def test_ids_alone_are_the_same_and_counted_in_bounded_tasks(spark, monkeypatch):
    """Counting needs no strings of the pieces, and tasks do not grow with the n-grams."""
    from collections import Counter

    from gramloom.operators import counts as C
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "c", "abc", "▁abca"]
    v = spark.createDataFrame([(k + 3, p, -1.0 - k % 3, True) for k, p in enumerate(pieces)],
                              "id int, piece string, score double, cacheable boolean")
    texts = ["abc  abca cab", "", None, "xyz ab\x85a", "c c　c ａｂ"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    want = {r.k: r.ids for r in SW.encode_subword(df, ["k"], "t", v).collect()}
    alone = SW.encode_subword(df, ["k"], "t", v, ids_only=True).cache()
    assert alone.columns == ["k", "ids"] and {r.k: r.ids for r in alone.collect()} == want
    grams = Counter(g for ids in want.values() for x in [[-1, -1, *ids, -2]] for g in zip(x, x[1:], x[2:]))
    monkeypatch.setattr(C, "TASK_GRAMS", 4)
    counted = C.ids_ngram_counts(alone, "ids", 3, total=sum(grams.values()))
    assert {tuple(r)[:3]: r.cnt for r in counted.collect()} == grams
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert C.ids_ngram_counts(alone, "ids", 3, total=100).rdd.getNumPartitions() == 25
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_segmenter_takes_the_pieces_of_viterbi():
    import random
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 5))) for _ in range(40)} - {"c"})
    scores = [-float(rng.randint(1, 4)) for _ in pieces]
    seg = SW.Segmenter(pieces, scores, 4)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9)))
        assert seg.best(word) == SW.viterbi(word, dict(zip(pieces, scores)), 4)[0]
