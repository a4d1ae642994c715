"""Store layer (A3-A13): sharded manifest, pruned lookups, model choice,
CSV rows, flat export, neural save/load."""
import csv
import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.sources import store as ST


def model_df(spark, rows):
    return spark.createDataFrame(rows, "w1 int, w2 int, w3 int, cnt bigint")


def test_sharded_single_context_keeps_requested_count(spark):
    path = ST.scratch_path(spark, "one_ctx")
    ST.write_sharded(model_df(spark, [(12, 34, 5, 3)]), path, 64)
    assert ST.read_manifest(spark, path) == 64
    assert os.path.isdir(os.path.join(path.replace("file:", ""), "shard=6"))
    ctx = spark.createDataFrame([(12, 34), (1, 2)], "w1 int, w2 int")
    got = [tuple(r) for r in ST.read_sharded(spark, path, ctx).select("w1", "w2", "w3", "cnt").collect()]
    assert got == [(12, 34, 5, 3)]


def test_sharded_lookup_prunes_partitions(spark):
    path = ST.scratch_path(spark, "prune")
    ST.write_sharded(model_df(spark, [(i, i + 1, 7, 1) for i in range(200)]), path, 64)
    ctx = spark.createDataFrame([(12, 13)], "w1 int, w2 int")
    plan = ST.read_sharded(spark, path, ctx)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*shard#\d+ (=|IN) ", plan)


def test_load_model_order(spark):
    base = ST.scratch_path(spark, "models")
    with pytest.raises(FileNotFoundError):
        ST.load_model(spark, base)
    with pytest.raises(FileNotFoundError):
        ST.read_partials(spark, f"{base}/trigram_parts")
    bi = spark.createDataFrame([("<BOS>", "a", 1)], "w1 string, w2 string, cnt bigint")
    ST.write_bigram(bi, f"{base}/bigram")
    assert ST.load_model(spark, base)[1] == "bigram"
    parts = model_df(spark, [(-1, -1, 3, 1)]).withColumn("part_id", F.lit(0))
    ST.write_partial(parts, f"{base}/trigram_parts")
    assert ST.read_partials(spark, f"{base}/trigram_parts").select("w3", "cnt", "part_id").collect() == [(3, 1, 0)]
    with pytest.raises(FileNotFoundError):
        ST.load_model(spark, base)
    ST.write_trigram(model_df(spark, [(-1, -1, 3, 1)]), f"{base}/trigram")
    assert ST.load_model(spark, base)[1] == "trigram"
    ST.write_sharded(model_df(spark, [(-1, -1, 3, 1)]), f"{base}/trigram_shards", 8)
    assert ST.load_model(spark, base)[1] == "sharded_trigram"


def test_partial_rewrite_replaces_only_its_chunk(spark):
    path = ST.scratch_path(spark, "parts")
    ST.write_partial(model_df(spark, [(1, 1, 1, 5)]).withColumn("part_id", F.lit(0)), path)
    ST.write_partial(model_df(spark, [(2, 2, 2, 7)]).withColumn("part_id", F.lit(1)), path)
    ST.write_partial(model_df(spark, [(3, 3, 3, 9)]).withColumn("part_id", F.lit(0)), path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("part_id", "w1", "cnt").collect())
    assert got == [(0, 3, 9), (1, 2, 7)]


def test_tree_csv_file(spark):
    from gramloom.plans.tree import write_tree_csv
    nodes = spark.createDataFrame(
        [(1, 0, None, None, "<ROOT>", 'say "hi"', False), (1, 1, 0, 5, "▁a,b", "x", False),
         (1, 2, 0, -2, "<EOS>", "y", True), (1, 3, 1, 9, "!!", "z", False)],
        "prompt_id long, node_id int, parent_id int, token_id int, piece string, text string, is_terminal boolean")
    path = ST.scratch_path(spark, "csv")
    write_tree_csv(nodes, path)
    files = glob.glob(os.path.join(path.replace("file:", ""), "prompt_id=1", "*.csv"))
    assert len(files) == 1
    with open(files[0], encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f))
    assert rows == [["token"], ['say "hi"'], ["ab"], ["EOS"], [""]]


def test_tree_buckets(spark):
    """Folders stay few however many prompts; marks inside tokens survive."""
    from gramloom.plans.tree import read_tree_buckets, summary_of_buckets, write_tree_buckets
    rows = [(p, n, None if n == 0 else 0, None if n == 0 else 7, "<ROOT>" if n == 0 else f"w{n}", f'say "{p}",\nnow', False)
            for p in range(40) for n in range(p % 3 + 1)]
    nodes = spark.createDataFrame(
        rows, "prompt_id long, node_id int, parent_id int, token_id int, piece string, text string, is_terminal boolean")
    path = ST.scratch_path(spark, "buckets")
    write_tree_buckets(nodes, path, buckets=4)
    assert len(glob.glob(os.path.join(path.replace("file:", ""), "bucket=*"))) <= 4
    got = read_tree_buckets(spark, path, "bigint")
    want = {(r[0], r[1], r[5] if r[1] == 0 else r[4]) for r in rows}
    assert {(r["prompt_id"], r["node_id"], r["token"]) for r in got.collect()} == want
    by = {r["prompt_id"]: json.loads(r["json"]) for r in summary_of_buckets(got, "trigram", "out/").collect()}
    assert len(by) == 40 and all(by[p]["node_count"] == p % 3 + 1 and by[p]["output_csv"].startswith("out/bucket=") for p in by)


def test_neural_save_load(spark):
    from gramloom.plans import neural as N
    cfg = N.NeuralConfig(vocab_size=11, embed_dim=4, hidden_dim=5, bos_token_id=10)
    w = N.init_weights(cfg, 1)
    df = N.weights_frame(spark, w, 1)
    path = ST.scratch_path(spark, "nn")
    N.save_neural(df, cfg, path)
    df2, cfg2 = N.load_neural(spark, path)
    assert cfg2 == cfg
    w2 = N.rows_to_weights(df2.toPandas())
    assert all((w[k] == w2[k]).all() for k in w)
    import numpy as np
    logits, _ = N.forward(w2, np.array([[10, 10, 10, 3]]))
    assert logits.shape == (1, 10)


def test_neural_samples_golden(spark):
    from gramloom.operators import vocab as VO
    from gramloom.plans import neural as N
    lines = spark.createDataFrame([(0, 0, "a b c")], "doc_id long, line_no int, line string")
    v = VO.build_vocab(spark.createDataFrame([(0, 0, "a a a b b c")], "doc_id long, line_no int, line string"), "word", 100)
    ids = {r.piece: r.id for r in v.collect()}
    cfg = N.NeuralConfig(vocab_size=99, bos_token_id=99)
    got = sorted((tuple(r.context), r.target) for r in N.build_samples(lines, v, cfg, 100).collect())
    a, b, c = ids["a"], ids["b"], ids["c"]
    assert got == sorted([((99, 99, 99, 99), a), ((99, 99, 99, a), b), ((99, 99, a, b), c)])


def test_softmax_top_k():
    import numpy as np
    from gramloom.plans.neural import softmax_top_k
    logits = np.log(np.array([[1.0, 4.0, 2.0, 3.0]]))
    idx, p = softmax_top_k(logits, 2, 1.0)
    assert idx.tolist() == [[1, 3]] and np.allclose(p, [[4 / 7, 3 / 7]])
    idx, p = softmax_top_k(logits, 0, 1.0)
    assert np.allclose(p[0][idx[0]], [0.1, 0.4, 0.2, 0.3])
    idx, p = softmax_top_k(logits, 2, 0.5)
    assert np.allclose(p, [[16 / 25, 9 / 25]])


def test_read_text_files_and_export(spark, tmp_path):
    from gramloom.sources.lines import clean_lines, read_text_files
    (tmp_path / "a.txt").write_text("x y\n\n z \n", encoding="utf-8")
    lines = read_text_files(spark, str(tmp_path))
    got = sorted((r.line_no, r.line) for r in lines.collect())
    assert got == [(0, "x y"), (1, ""), (2, " z ")]
    assert [r.line for r in clean_lines(lines).orderBy("line_no").collect()] == ["x y", "z"]
    m = model_df(spark, [(1, 2, 3, 4), (1, 2, 5, 6)])
    ST.export_counts_table(m, "gramloom_counts_test")
    assert spark.table("gramloom_counts_test").count() == 2
    assert ST.duplicate_keys(spark.table("gramloom_counts_test")).count() == 0
    ST.export_counts_table(m.limit(1), "gramloom_counts_test")
    assert spark.table("gramloom_counts_test").count() == 1
    spark.sql("DROP TABLE gramloom_counts_test")


def test_text_file_line_numbers_across_splits(spark, tmp_path):
    from gramloom.sources.lines import read_text_files
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "small.txt").write_text("a\nb\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_text_files(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.line_no, r.line))
    got = sorted(sorted(v) for v in by_doc.values())
    assert got == sorted([list(enumerate(["a", "b"])), list(enumerate(lines))])


def test_flat_export_replaces_and_refuses_repeated_keys(spark):
    name = "flat_counts_test"
    try:
        ST.export_counts_table(model_df(spark, [(1, 2, 3, 4), (1, 2, 5, 6)]), name)
        ST.export_counts_table(model_df(spark, [(7, 8, 9, 1)]), name)
        assert [tuple(r) for r in spark.table(name).collect()] == [(7, 8, 9, 1)]
        with pytest.raises(ValueError):
            ST.export_counts_table(model_df(spark, [(1, 2, 3, 4), (1, 2, 3, 5)]), name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_sharded_write_makes_few_files(spark):
    path = ST.scratch_path(spark, "few")
    rows = spark.range(4000).selectExpr("cast(id as int) w1", "7 as w2", "1 as w3", "1L as cnt").repartition(32)
    ST.write_sharded(rows, path, 8)
    files = glob.glob(path.replace("file:", "") + "/shard=*/part-*.parquet")
    assert len(files) <= 8 * ST.WRITERS_PER_SHARD


def test_flat_export_counts_keys_while_it_writes(spark, tmp_path, monkeypatch):
    """No second pass over the model; a free path becomes the table, a used one keeps its table until all is checked."""
    monkeypatch.setattr(ST, "duplicate_keys", None)
    name, path = "flat_counts_once", str(tmp_path / "flat")
    try:
        ST.export_counts_table(model_df(spark, [(1, 2, 3, 4), (1, 2, 5, 6)]), name, path)
        assert spark.table(name).schema.simpleString() == "struct<w1:int,w2:int,w3:int,cnt:bigint>"
        assert sorted(map(tuple, spark.table(name).collect())) == [(1, 2, 3, 4), (1, 2, 5, 6)]
        assert glob.glob(path + "/part-*")
        with pytest.raises(ValueError):
            ST.export_counts_table(model_df(spark, [(1, 2, 3, 4)] * 2), name, path)
        assert spark.table(name).count() == 2
        ST.export_counts_table(model_df(spark, [(7, 8, 9, 1)]), name, path)
        assert [tuple(r) for r in spark.table(name).collect()] == [(7, 8, 9, 1)]
        ST.export_counts_table(model_df(spark, []), name, str(tmp_path / "none"))
        assert spark.table(name).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
