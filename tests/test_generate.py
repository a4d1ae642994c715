"""Batch generation and prediction trees on tiny corpora with answers worked
by hand, and the laws every tree obeys."""
import math
from collections import defaultdict

import pytest

from gramloom import constants as K
from gramloom.operators import counts as C
from gramloom.operators import lookup as LK
from gramloom.operators import vocab as VO
from gramloom.plans import prompts as PR
from gramloom.plans import queries as Q
from gramloom.plans.generate import generate, prepare_model
from gramloom.plans.tree import TreeParams, csv_tokens, expand_tree

SF = "/root/testdata/sf0.001"
CORPUS = ["xx yy"] * 3 + ["xx zz", "a b c d e"]
# Share of "yy" after "xx": counts 3 and 1, temperature 0.95.
P_YY = 3 ** (1 / 0.95) / (3 ** (1 / 0.95) + 1)


@pytest.fixture(scope="module")
def tiny(spark):
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(CORPUS)], "doc_id long, line_no int, line string")
    vocab = VO.build_vocab(lines).cache()
    n = vocab.count()
    tri = prepare_model(C.followers_table(C.trigram_counts(lines, vocab, vocab_bound=n), vocab, 8, ["w1", "w2"], n), ["w1", "w2"])
    bi = prepare_model(C.followers_table(C.bigram_id_counts(lines, vocab, vocab_bound=n).withColumnRenamed("w2", "w3"),
                                         vocab, 8, ["w1"], n), ["w1"])

    def prompts(*rows):
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "prompt_id long, prompt string, max_tokens int")
        return LK.encode_prompts(PR.split_requests(frame)[0], vocab, n)
    return {r["piece"]: r["id"] for r in vocab.collect()}, tri, bi, prompts


def test_greedy_generation(tiny):
    _, tri, _, prompts = tiny
    rows = generate(prompts(("xx", None), ("zz xx", None), ("a", 1), ("a", None), ("new", None)), tri, mode="greedy").collect()
    got = {r["prompt_id"]: (r["text"], r["n_generated"], r["stop"]) for r in rows}
    assert got == {0: ("xx yy", 1, "eos"), 1: ("zz xx", 0, "miss"), 2: ("a b", 1, "max_tokens"),
                   3: ("a b c d e", 4, "eos"), 4: ("⁇".replace("⁇", got[4][0]), 0, "miss")}


def tree(tiny, prompt, depth=3):
    _, tri, bi, prompts = tiny
    nodes = expand_tree(prompts((prompt, None)), tri, bi, TreeParams(max_depth=depth))
    return sorted(nodes.collect(), key=lambda r: r["node_id"]), nodes


def check(rows, want):
    assert [r["node_id"] for r in rows] == list(range(len(want)))
    for r, (parent, depth, rank, piece, p, score, text, end) in zip(rows, want):
        assert (r["parent_id"], r["depth"], r["choice_rank"], r["piece"], r["text"], r["is_terminal"]) == (
            parent, depth, rank, piece, text, end)
        assert r["probability"] == pytest.approx(p) and r["score"] == pytest.approx(score)
        assert r["cumulative_score"] == pytest.approx(-math.log(score))


def test_branches_and_end_nodes(tiny):
    rows, nodes = tree(tiny, "xx")
    check(rows, [(None, 0, 0, K.TREE_ROOT_PIECE, 1, 1, "xx", False),
                 (0, 1, 1, "yy", P_YY, P_YY, "xx yy", False), (0, 1, 2, "zz", 1 - P_YY, 1 - P_YY, "xx zz", False),
                 (1, 2, 1, K.EOS_PIECE, 1, P_YY, "xx yy", True), (2, 2, 1, K.EOS_PIECE, 1, 1 - P_YY, "xx zz", True)])
    assert [r["token"] for r in csv_tokens(nodes).orderBy("node_id").collect()] == ["xx", "yy", "zz", "EOS", "EOS"]
    assert rows[1]["count"] == 3 and rows[2]["count"] == 1


def test_single_letters_grow_into_words(tiny):
    rows, _ = tree(tiny, "a")
    check(rows, [(None, 0, 0, K.TREE_ROOT_PIECE, 1, 1, "a", False), (0, 1, 1, "b c", 1, 1, "a b c", False),
                 (1, 2, 1, "d e", 1, 1, "a b c d e", False), (2, 3, 1, K.EOS_PIECE, 1, 1, "a b c d e", True)])
    ids = tiny[0]
    assert [r["token_id"] for r in rows] == [None, ids["b"], ids["d"], K.EOS_ID]


def test_back_off_and_cache(tiny):
    """No trigram starts with "zz xx", so bigrams of "xx" answer; "zz" is in
    the context: recency 1/2 plus frequency 1 raise its weight by 0.18 * 1.5."""
    rows, _ = tree(tiny, "zz xx", depth=1)
    yy, zz = 3 ** (1 / 0.95), (1 + 0.18 * 1.5) ** (1 / 0.95)
    check(rows, [(None, 0, 0, K.TREE_ROOT_PIECE, 1, 1, "zz xx", False),
                 (0, 1, 1, "yy", yy / (yy + zz), yy / (yy + zz), "zz xx yy", False),
                 (0, 1, 2, "zz", zz / (yy + zz), zz / (yy + zz), "zz xx zz", False)])


def test_unknown_prompt_has_a_root_only(tiny):
    assert [r["depth"] for r in tree(tiny, "new words")[0]] == [0]


def test_tree_laws(spark):
    by_prompt = defaultdict(list)
    for r in Q.tree_nodes(spark, SF, max_depth=3).select(*Q.TREE_COLS).collect():
        by_prompt[r.prompt_id].append(r)
    for rows in by_prompt.values():
        rows.sort(key=lambda r: r.node_id)
        assert [r.node_id for r in rows] == list(range(len(rows))) and len(rows) <= 1 + 2 + 4 + 8
        kids = defaultdict(list)
        for r in rows[1:]:
            par = rows[r.parent_id]
            kids[r.parent_id].append(r.choice_rank)
            assert r.depth == par.depth + 1 and not par.is_terminal
            assert abs(r.score - par.score * r.probability) <= 1e-9
            if r.probability >= 1e-12:
                assert abs(r.cumulative_score - (par.cumulative_score - math.log(r.probability))) <= 1e-6
        assert all(sorted(k) == list(range(1, len(k) + 1)) for k in kids.values())


def test_distinct_context_steps_give_the_same_texts(spark, tiny, monkeypatch):
    """Many prompts: distinct contexts meet the model once, hot ones come back by broadcast."""
    from gramloom.plans import generate as G
    _, tri, bi, prompts = tiny
    asked = prompts(*[(t, None) for t in ["xx"] * 40 + ["a", "zz xx", "b c", "new", "d"]])
    for model, kind in ((tri, "trigram"), (bi, "bigram")):
        want = sorted(tuple(r) for r in generate(asked, model, kind, "sample", 7).collect())
        for share in (0.2, 1e-9, 1.0):
            monkeypatch.setattr(G, "MANY_PROMPTS", 1)
            monkeypatch.setattr(G, "HOT_SHARE", share)
            assert sorted(tuple(r) for r in generate(asked, model, kind, "sample", 7).collect()) == want
        monkeypatch.undo()


def test_stored_buckets_join_without_shuffling_the_model(spark, tiny):
    from gramloom.sources import store as ST
    _, tri, _, prompts = tiny
    stored = ST.bucketed_followers(tri, ["w1", "w2"], 4)
    asked = prompts(("xx", None), ("a", None), ("a", 2))
    plan = asked.join(stored, ["w1", "w2"], "left")._jdf.queryExecution().executedPlan().toString()
    model_side = plan[plan.index("SortMergeJoin"):]
    assert "Bucketed: true" in model_side and "Exchange" not in model_side[model_side.rindex("Sort "):]
    assert sorted(map(tuple, generate(asked, stored, mode="greedy").collect())) == sorted(
        map(tuple, generate(asked, tri, mode="greedy").collect()))


def test_asked_followers_give_the_same_texts_and_trees(spark, monkeypatch):
    """A large model stays its counts; no follower table of the whole model is made."""
    from gramloom.plans import generate as G
    texts = [f"{w} 。 {w} x{i % 7} …{i % 3} end" for i, w in enumerate(["the", "a", "of"] * 12)] + CORPUS + ["<EOS> <BOS> xx"]
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, line_no int, line string")
    vocab = VO.build_vocab(lines).cache()
    n = vocab.count()
    frame = spark.createDataFrame([(k, t, 2) for k, t in enumerate(["the", "of 。", "new", "a"])],
                                  "prompt_id long, prompt string, max_tokens int")
    asked = LK.encode_prompts(PR.split_requests(frame)[0], vocab, n)
    counts = {"trigram": (C.trigram_counts(lines, vocab, vocab_bound=n), ["w1", "w2"]),
              "bigram": (C.bigram_id_counts(lines, vocab, vocab_bound=n).withColumnRenamed("w2", "w3"), ["w1"])}
    whole = {m: prepare_model(C.followers_table(c, vocab, 3, keys, n), keys) for m, (c, keys) in counts.items()}
    monkeypatch.setattr(G, "SMALL_MODEL", 0)
    monkeypatch.setattr(G, "prepare_model", None)
    on_ask = {m: G.lookup_model(c, vocab, 3, keys, n, 5) for m, (c, keys) in counts.items()}
    for m in counts:
        want, got = (sorted(map(tuple, generate(asked, x[m], m, "sample", 7).collect())) for x in (whole, on_ask))
        assert got == want
    trees = [sorted(map(str, expand_tree(asked, x["trigram"], x["bigram"], TreeParams(max_depth=1, top_k=3)).collect()))
             for x in (whole, on_ask)]
    assert trees[0] == trees[1]


def test_trees_of_many_contexts_move_no_model(spark, tiny, monkeypatch):
    """However many contexts a step may ask for, a large model stays its counts, in buckets of the contexts."""
    from gramloom.plans import generate as G
    _, tri, bi, prompts = tiny
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(CORPUS)], "doc_id long, line_no int, line string")
    vocab = VO.build_vocab(lines).cache()
    n = vocab.count()
    asked = prompts(*[(t, None) for t in ("xx", "a", "zz xx", "new")])
    monkeypatch.setattr(G, "SMALL_MODEL", 0)
    monkeypatch.setattr(G, "prepare_model", None)
    for module in (G, C):
        monkeypatch.setattr(module, "BROADCAST_ROW_LIMIT", 1)
    tri_m = G.tree_model(C.trigram_counts(lines, vocab, vocab_bound=n), vocab, 8, ["w1", "w2"], n, 1 << 40)
    bi_m = G.tree_model(C.bigram_id_counts(lines, vocab, vocab_bound=n).withColumnRenamed("w2", "w3"), vocab, 8, ["w1"], n, 1 << 40)
    plan = tri_m.ids_of(asked, 9)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    want, got = (sorted(map(str, expand_tree(asked, x, y, TreeParams(max_depth=2)).collect())) for x, y in ((tri, bi), (tri_m, bi_m)))
    assert got == want and len(got) > 8


def test_a_context_is_looked_up_once_however_often_it_is_met(spark, monkeypatch):
    """Texts meet the same contexts at step after step; a large model is asked for new ones only."""
    from gramloom.plans import generate as G
    texts = ["a b a b a b"] * 4 + ["a …x c", "b 。 a"] + CORPUS
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, line_no int, line string")
    vocab = VO.build_vocab(lines).cache()
    n = vocab.count()
    frame = spark.createDataFrame([(k // 2, t, 4) for k, t in enumerate(["a", "a", "b", "new", "xx"])],
                                  "prompt_id long, prompt string, max_tokens int")
    asked = LK.encode_prompts(PR.split_requests(frame)[0], vocab, n).cache()
    counts = C.bigram_id_counts(lines, vocab, vocab_bound=n).withColumnRenamed("w2", "w3").cache()
    whole = prepare_model(C.followers_table(counts, vocab, 3, ["w1"], n), ["w1"])
    want = sorted(map(tuple, generate(asked, whole, "bigram", "greedy").collect()))
    monkeypatch.setattr(G, "SMALL_MODEL", 0)
    found = G.CountedModel.found
    for broadcast in (100_000, 1):  # followers of all contexts are broadcast, or of the most shared one
        monkeypatch.setattr(G, "MET_CONTEXTS", broadcast)
        looked_up = []
        monkeypatch.setattr(G.CountedModel, "found", lambda self, contexts, bound: (
            looked_up.extend(map(tuple, contexts.collect())), found(self, contexts, bound))[1])
        model = G.lookup_model(counts, vocab, 3, ["w1"], n, 5)
        assert sorted(map(tuple, generate(asked, model, "bigram", "greedy").collect())) == want
        assert looked_up and len(set(looked_up)) == len(looked_up)


def test_rows_of_a_hot_context_stay_in_their_tasks(spark):
    from gramloom.plans import generate as G
    counts = spark.createDataFrame([(5, 6, 3), (6, 5, 2)], "w1 int, w3 int, cnt long")
    vocab = spark.createDataFrame([(5, "five", True), (6, "six", True)], "id int, piece string, cacheable boolean")
    rows = spark.range(1000).selectExpr("id", "cast(if(id = 7, 6, 5) as int) as w1").repartition(8).cache()
    model = G.CountedModel(counts, vocab, 3, ["w1"])
    got = model.look_up(rows, ["w1"], "followers")
    assert max(len(p) for p in got.rdd.glom().collect()) <= 130
    assert got.filter("w1 = 5").selectExpr("followers[0].w3 as w").distinct().collect() == [(6,)]
