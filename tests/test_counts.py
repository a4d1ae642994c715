"""Counting laws and golden counts."""
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions.arrays import shard_of
from gramloom.operators import counts as C
from gramloom.operators import vocab as VO

LINES = ["a b a b", "", "  a b  ", "b"]


def lines_df(spark):
    from gramloom.sources.lines import clean_lines
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(LINES)], "doc_id long, line_no int, line string")
    return clean_lines(df)


def test_bigram_golden(spark):
    got = {(r.w1, r.w2): r.cnt for r in C.bigram_counts(lines_df(spark)).collect()}
    B, E = K.BOS_PIECE, K.EOS_PIECE
    assert got == {(B, "a"): 2, (B, "b"): 1, ("a", "b"): 3, ("b", "a"): 1, ("b", E): 3}


def test_trigram_golden(spark):
    lines = lines_df(spark)
    v = VO.build_vocab(lines, "word", 100)
    ids = {r.piece: r.id for r in v.collect()}
    got = {(r.w1, r.w2, r.w3): r.cnt for r in C.trigram_counts(lines, v, vocab_bound=100).collect()}
    a, b, B, E = ids["a"], ids["b"], K.BOS_ID, K.EOS_ID
    assert got == {(B, B, a): 2, (B, B, b): 1, (B, a, b): 2, (B, b, E): 1, (a, b, E): 2, (a, b, a): 1, (b, a, b): 1}
    assert sum(got.values()) == 10


def test_partials_merge_to_direct(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    from gramloom.sources.lines import corpus_lines
    lines = corpus_lines(spark, "/root/testdata/sf0.001", normalize=True)
    v = VO.build_vocab(lines, "word", 5000)
    direct = C.trigram_counts(lines, v, vocab_bound=5000)
    for m in (97, 100000):
        merged = C.merge_partials(C.partial_counts(docs, v, m, vocab_bound=5000))
        assert merged.exceptAll(direct).count() == 0 and direct.exceptAll(merged).count() == 0
    nested = C.to_long(C.to_nested(direct)).select("w1", "w2", "w3", "cnt")
    assert nested.exceptAll(direct).count() == 0 and direct.count() == nested.count()


def test_shard_golden(spark):
    df = spark.createDataFrame([(-1, -1), (-1, 5), (5, -2), (31999, 31998), (12, 34)], "w1 int, w2 int")
    got = df.select(shard_of(F.col("w1"), F.col("w2"), 64).alias("a"), shard_of(F.col("w1"), F.col("w2"), 8).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(2, 2), (56, 0), (49, 1), (3, 3), (6, 6)]


def test_global_line_index_dense(spark):
    from gramloom.sources.lines import doc_lines, indexed_lines
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    idx = indexed_lines(doc_lines(docs))
    rows = idx.select("doc_id", "line_no", "idx").orderBy("doc_id", "line_no").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))


def test_direct_id_bigrams_equal_rekeyed_strings(spark):
    from gramloom.sources.lines import clean_lines
    rows = ["a b <EOS> c", "zz yy a", "<BOS> a q", "b"]
    lines = clean_lines(spark.createDataFrame([(0, i, s) for i, s in enumerate(rows)],
                                              "doc_id long, line_no int, line string"))
    v = VO.build_vocab(spark.createDataFrame([(0, 0, "a a b c")], "doc_id long, line_no int, line string"),
                       "word", 10)
    direct = C.bigram_id_counts(lines, v, vocab_bound=10)
    rekeyed = VO.bigram_to_ids(C.bigram_counts(lines), v, 10)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, rekeyed.collect()))
    assert rekeyed.filter("w1 = 0").count() > 0 and rekeyed.filter("w2 = -2 AND w1 >= 3").count() > 0


def _rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def _open_corpus(spark):
    from gramloom.sources.lines import corpus_lines
    lines = corpus_lines(spark, "/root/testdata/sf0.001", normalize=True)
    extra = spark.createDataFrame([(-1, i, s) for i, s in enumerate(
        ["<BOS> x <EOS>", "zzz " * 40 + "y" * 100, "q", "q unseen1 unseen2 q", "q unseen2 unseen1 q"])],
        "doc_id long, line_no int, line string")
    return lines.unionByName(extra)


def test_open_vocabulary_counts_equal_bounded(spark, monkeypatch):
    """Without a broadcast bound: head broadcast, tail joined on distinct rows."""
    from gramloom.session import cut_lineage
    monkeypatch.setattr(VO, "HEAD_PIECES", 50)
    lines = cut_lineage(_open_corpus(spark))
    for size in (None, 400):  # whole, and cut: unknown words share id 0
        v = cut_lineage(VO.build_vocab(lines, "word", size))
        assert _rows(C.trigram_counts(lines, v)) == _rows(C.trigram_counts(lines, v, vocab_bound=10 ** 6))
        assert _rows(C.bigram_id_counts(lines, v)) == _rows(C.bigram_id_counts(lines, v, vocab_bound=10 ** 6))
    tri = C.trigram_counts(lines, v, vocab_bound=10 ** 6)
    asked = cut_lineage(tri.select("w1", "w2").distinct().limit(30))
    assert _rows(C.trigram_counts(lines, v, contexts=asked, contexts_bound=30)) == _rows(
        C.trigram_counts(lines, v, vocab_bound=10 ** 6, contexts=asked, contexts_bound=30))
    strings = C.bigram_counts(lines)
    assert _rows(VO.bigram_to_ids(strings, v, None)) == _rows(VO.bigram_to_ids(strings, v, 10 ** 6))
    rows = lambda b: C.id_ngram_rows(lines, v, 2, extra_cols=["doc_id"], vocab_bound=b)
    assert _rows(rows(None)) == _rows(rows(10 ** 6))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert _rows(C.partial_counts(docs, v, 100)) == _rows(C.partial_counts(docs, v, 100, vocab_bound=10 ** 6))


def test_open_vocabulary_counts_strings_before_any_shuffled_join(spark, monkeypatch):
    """One exchange before the ids: the first job has an aggregate and
    broadcast joins only."""
    seen = []
    cut = C.cut_lineage
    lines = lines_df(spark)
    v = cut(VO.build_vocab(lines, "word"))
    monkeypatch.setattr(C, "cut_lineage", lambda df: seen.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    C.trigram_counts(lines, v)
    plan = seen[0]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 3 and plan.count("hashpartitioning(s0") == 1


def test_exploding_lines_adds_no_filter_on_the_split(spark):
    from gramloom.sources import lines as L
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    per_doc = L.valid_doc_lines(docs, normalize=True)
    for df in (L.read_lines(docs), L.indexed_lines(per_doc)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in plan


def test_line_positions_of_awkward_tables(spark):
    """Null and far apart ids, null and empty texts, no rows; any number of ranges."""
    from gramloom.sources.lines import doc_lines, indexed_lines
    rows = [(None, "last\nlines"), (7, "g\n\nh"), (-3, "a"), (1 << 60, "z"), (5, None), (0, ""), (2, "b\r\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = ["a", "", "b", "c", "g", "", "h", "z", "last", "lines"]
    for n in (1, 3, 1024):
        got = sorted((r.idx, r.line) for r in indexed_lines(doc_lines(docs), num_buckets=n).collect())
        assert got == list(enumerate(want))
    assert indexed_lines(doc_lines(docs.limit(0))).count() == 0


def test_chunk_numbering_reads_the_text_once(spark):
    from gramloom.sources import lines as L
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lines = L.indexed_lines(L.valid_doc_lines(docs, normalize=True))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "SortMergeJoin" not in plan


def test_chunk_statistics(spark):
    docs = spark.createDataFrame([(1, "a b\n\na b"), (2, "c"), (3, "a")], "doc_id long, text string")
    v = VO.build_vocab(spark.createDataFrame([("a b c",)], "line string"))
    got = sorted(map(tuple, C.partial_stats(C.partial_counts(docs, v, 2, vocab_bound=9)).select(
        "part_id", "n_lines", "n_samples", "contexts", "model_rows").collect()))
    assert got == [(0, 2, 6, 3, 3), (1, 2, 4, 3, 4)]


def test_lines_are_encoded_with_a_vocabulary_of_any_size(spark, monkeypatch):
    """Rare, repeated, unknown and sentinel-like words, empty and null lines."""
    monkeypatch.setattr(VO, "HEAD_PIECES", 2)
    rows = ["a b c a c", "", None, "d unseen d c unseen", "<BOS> a <unk>", "b", "c" * 70 + " a　d"]
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "k long, line string")
    v = VO.build_vocab(spark.createDataFrame([("a a a b b c d <BOS> " + "c" * 70,)], "line string")).cache()
    ids = {r.piece: r.id for r in v.collect()}
    for literal in (None, {"<BOS>": -1}):
        known = ids | {"<unk>": 0} | (literal or {})
        want = [(i, [known.get(w, 0) for w in (s or "").split()]) for i, s in enumerate(rows)]
        got = VO.encode_lines(lines, v, ["k"], literal=literal).orderBy("k").collect()
        assert [(r.k, r.ids) for r in got] == want
    got = VO.encode_lines(lines.filter("k = 6"), v, ["k"], "char").first()
    assert got.ids == [ids["c"]] * 70 + [0, ids["a"], 0, ids["d"]]


def test_counting_moves_ids_and_rare_words_only(spark, monkeypatch):
    """No exchange of words in front of the count, however large the vocabulary."""
    monkeypatch.setattr(VO, "HEAD_PIECES", 1)
    lines = lines_df(spark)
    v = VO.build_vocab(lines).cache()
    plan = C.trigram_counts(lines, v, vocab_bound=10 ** 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(piece") <= 2 and "hashpartitioning(t" not in plan and "p0" not in plan


def test_followers_of_an_open_vocabulary(spark, monkeypatch):
    """Pieces by the head where it holds them, by a shuffle else: the same rows, and no exchange of the whole model."""
    monkeypatch.setattr(C, "HEAD_PIECES", 20)
    lines = _open_corpus(spark)
    v = VO.build_vocab(lines).cache()
    model = C.trigram_counts(lines, v, vocab_bound=10 ** 6).cache()
    as_rows = lambda b: sorted(map(str, C.followers_table(model, v, 4, ["w1", "w2"], b).collect()))
    assert as_rows(None) == as_rows(10 ** 6)
    assert "BroadcastHashJoin" in C.with_pieces(model, v, None)._jdf.queryExecution().executedPlan().toString()


def test_prefixes_are_made_after_the_ids(spark, monkeypatch):
    """Every prefix's words and ids, rare and unfinished words included; no exchange or stored table holds a prefix."""
    monkeypatch.setattr(VO, "HEAD_PIECES", 1)
    texts = ["ab  abc　a", " x ab", "", "abc"]
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "k long, line string")
    v = VO.build_vocab(spark.createDataFrame([("ab ab abc x",)], "line string")).cache()
    ids = {r.piece: r.id for r in v.collect()}
    want = []
    for i, s in enumerate(texts):
        s = s.strip()
        want += [(i, n, s[:n].split(), [ids.get(w, 0) for w in s[:n].split()]) for n in range(1, len(s) + 1)]
    df = VO.prefix_pieces(lines, ["k"], v)
    assert [tuple(r) for r in df.orderBy("k", "plen").collect()] == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(_from") < plan.index("Exchange")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_counting_tasks_are_bounded_by_their_n_grams(spark, monkeypatch):
    """More n-grams than the session's partitions hold get more tasks, and the counts are the same."""
    monkeypatch.setattr(VO, "HEAD_PIECES", 1)
    lines = lines_df(spark)
    v = VO.build_vocab(lines).cache()
    want = sorted(map(tuple, C.trigram_counts(lines, v, vocab_bound=10).collect()))
    monkeypatch.setattr(C, "TASK_GRAMS", 1)
    many = C.trigram_counts(lines, v, vocab_bound=10)
    assert sorted(map(tuple, many.collect())) == want and sum(r[3] for r in want) == 10
    assert ", 10), REPARTITION_BY_NUM" in _plan(many)


def test_merging_partials_moves_nothing_again(spark, monkeypatch):
    """Partials dealt by their ids are merged where they lie; a chunk's statistics move no n-gram twice."""
    monkeypatch.setattr(VO, "HEAD_PIECES", 1)
    docs = spark.createDataFrame([(k, "a b a b\nb c d\n\na b") for k in range(5)] + [(None, "a a"), (1, "a b a b")], "doc_id long, text string")
    from gramloom.sources.lines import clean_lines, read_lines
    lines = clean_lines(read_lines(docs), normalize=True)
    v = VO.build_vocab(lines).cache()
    direct = C.trigram_counts(lines, v, vocab_bound=10)
    parts = C.partial_counts(docs, v, 3, vocab_bound=10, deal=["w1", "w2", "w3"])
    merged = C.merge_partials(parts)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
    assert "hashpartitioning(part_id" not in _plan(merged) and _plan(merged).count("hashpartitioning(w1") == 1
    assert _plan(C.shard_and_reduce(parts)).count("hashpartitioning(") == _plan(merged).count("hashpartitioning(")
    chunks = C.partial_counts(docs, v, 3, vocab_bound=10)
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, parts.collect()))
    assert "hashpartitioning(part_id#" in _plan(chunks) and _plan(C.partial_stats(chunks)).count("w1#") > 0
    stats = [x.split("(", 1)[1].split(")")[0] for x in _plan(C.partial_stats(chunks)).split("Exchange ") if x.startswith("hashpartitioning(part_id")]
    assert all("w2#" not in x for x in stats)


def test_prompts_are_encoded_where_they_lie(spark, monkeypatch):
    """Rows stay rows, whatever the vocabulary's size; rows of one key share their tokens, a null key has none."""
    from gramloom.operators import lookup as LK
    prompts = spark.createDataFrame([(1, "a a b"), (2, " b　c !"), (None, "a"), (3, ""), (4, "b new"), (4, "a <s>")], "prompt_id long, prompt string")
    v = VO.build_vocab(spark.createDataFrame([("a a b b b c ! !",)], "line string")).cache()
    ids = {r.piece: r.id for r in v.collect()}
    a, b, c, m = ids["a"], ids["b"], ids["c"], ids["!"]
    want = {(1, a, b, (a, a, b)), (2, c, m, (b, c, m)), (None, -1, -1, ()), (3, -1, -1, ()), (4, 0, 0, (*sorted((a, b)), 0, 0))}
    for head in (VO.HEAD_PIECES, 1):
        monkeypatch.setattr(VO, "HEAD_PIECES", head)
        for bound in (None, 10):
            got = LK.encode_prompts(prompts, v, bound)
            rows = got.collect()
            assert {(r.prompt_id, r.w1, r.w2, tuple(r.pids)) for r in rows} == want and len(rows) == 6
            flags = {(t.piece, t.cacheable) for r in rows for t in r.pids_tok}
            assert flags == {("a", True), ("b", True), ("c", True), ("!", False), (K.UNK_SURFACE, True)}
        if head > 1:
            assert "Generate" not in _plan(got) and "Join" not in _plan(got)


def test_follower_ids_need_no_pieces(spark):
    lines = _open_corpus(spark)
    v = VO.build_vocab(lines).cache()
    model = C.trigram_counts(lines, v, vocab_bound=10 ** 6).cache()
    rows = lambda t: sorted((r.w1, r.w2, [(f.w3, f.cnt, f.cacheable) for f in r.followers]) for r in t.collect())
    ids = C.follower_ids(model, v, 4, ["w1", "w2"])
    assert rows(ids) == rows(C.followers_table(model, v, 4, ["w1", "w2"], 10 ** 6))
    assert "piece#" not in _plan(ids).split("InMemoryTableScan")[0]


def test_nesting_moves_nothing_that_was_counted_by_bucket(spark, monkeypatch):
    """Counts dealt by context and bucket of the follower are nested where they lie."""
    from gramloom.operators import vocab as VO
    monkeypatch.setattr(VO, "HEAD_PIECES", 2)
    texts = [f"a b c{i} d{i % 3} a b" for i in range(30)]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    v = VO.build_vocab(lines).cache()
    n = v.count()
    model = C.id_ngram_counts(lines, v, 3, 2, vocab_bound=n, salt_buckets=4)
    nested = C.to_nested(model, 4)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan.split("ObjectHashAggregate")[0] and "Exchange hashpartitioning(w1#" in plan
    above = plan[:plan.index("Exchange hashpartitioning(w1#")]
    assert "Exchange" not in above and "HashAggregate(keys=[bucket#" in above
    assert sorted(map(tuple, C.to_long(nested).collect())) == sorted(
        tuple(r) for r in C.trigram_counts(lines, v, vocab_bound=n).select("w1", "w2", "w3", "cnt").collect())
