"""The pipeline against its stages' rules, and the entry's queries."""
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gramloom.llm import quality
from gramloom.llm.tokens import default_tokenizer
from tests.llm.data import prose
from tests.llm.test_scans import shingles
from tests.llm.test_simhash import plain_classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    good = [prose(rng, rng.randrange(80, 200), 800) for _ in range(60)]
    item = prose(rng, 30, 5000)
    key = "token = \"" + "ab12" * 10 + "\""
    rows = [*good, *(" | ".join("w%d" % rng.randrange(800) for _ in range(120)) for _ in range(30)),
            *(good[0] for _ in range(25)), good[1] + "\n" + item, good[2].replace(".", f". {key} ", 1) + prose(rng, 60, 800),
            "short", "", None]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in [*range(50), *range(60, 85)]],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline_equals_plain_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [r for r in quality.quality(docs, spark.read.parquet(f"{path}/labels.parquet")).collect() if r["kept"]]
    ids = sorted(r["doc_id"] for r in kept)
    assert set(range(60)) <= set(ids) and not set(range(60, 90)) & set(ids) and len(rows) - 1 not in ids
    label = plain_classes([plain_fingerprint(rows[k]) for k in ids])
    ids = [k for n, k in enumerate(ids) if label[n] == n]
    ids = [k for k in ids if not len(shingles(item) & shingles(rows[k])) >= 0.8 * len(shingles(item))]
    assert 0 in ids and not set(range(90, 116)) & set(ids)
    tok = Tokenizer.from_file(default_tokenizer())
    want = {}
    for k in ids:
        t = rows[k].replace("token = \"" + "ab12" * 10, "[SECRET]")
        want[k] = [*tok.encode(t, add_special_tokens=False).ids, 2]
    got, length = {}, {}
    for r in corpus_pipeline.run(spark, path).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        length[r["sequence_id"]] = length.get(r["sequence_id"], 0) + r["length"]
    assert got == want
    assert all(n == 4096 for s, n in length.items() if s < max(length))


def test_packing_writes_whole_sequences(spark, folder, monkeypatch):
    written = {}

    def kept(*args, **options):
        written["sequences"] = plain(*args, **options)
        return written["sequences"]
    plain = corpus_pipeline.packing.sequences
    monkeypatch.setattr(corpus_pipeline.packing, "sequences", kept)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    want = {}
    for r in corpus_pipeline.pack(spark, docs, folder[0]).orderBy("sequence_id", "offset").collect():
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + r["ids"]
    got = {r["sequence_id"]: bytes(r["ids"]) for r in written["sequences"].collect()}
    assert got == want and len(got) > 1


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_every_operator_is_registered_once():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.parametrize("name", ["op3_license_scans", "op4_benchmark_decontamination"])
def test_sql_oracles(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_packing_keeps_a_small_memo_in_the_pipeline(spark, monkeypatch):
    """What a worker keeps after the last stage is bounded by the pipeline's own figure, whatever the operator keeps."""
    import corpus_pipeline
    from gramloom.llm import packing, tokens
    asked = []
    monkeypatch.setattr(packing, "pack", lambda docs, **kw: asked.append(kw["memo_items"]) or docs)
    monkeypatch.setattr(packing, "sequences", lambda *a, **kw: None)
    corpus_pipeline.pack(spark, None, "")
    assert asked[0] * 4 < tokens.MEMO_ITEMS
    path = tokens.default_tokenizer()
    small, large = tokens.encoder(path, 10), tokens.encoder(path)
    texts = [f"word{k} of some number" for k in range(200)]
    for t in texts:
        assert small.encode([t]) == large.encode([t])
    assert len(small.memo.young) + len(small.memo.old) < 50 < len(large.memo.young)
