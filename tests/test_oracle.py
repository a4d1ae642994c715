"""Registered queries against their DuckDB oracles on the smallest tables
(same comparison as scripts/oracle_check.py)."""
import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
FAST = ["top_followers", "lines_normalized", "vocab_ids", "bigram_counts", "trigram_counts", "tokens_word",
        "next_top_k", "next_backoff", "cache_scores", "ranked_candidates", "shard_sizes",
        "trigram_partials", "partial_stats", "limit_lines", "word_like", "char_coverage", "next_exact", "greedy_text",
        "tree_depth1", "line_sample", "neural_samples", "tree_nodes", "prefix_pieces", "line_requests", "line_rejects",
        "lines_normalized_marks", "bigram_store", "counts_export", "shards_appended"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["w1", "w2", "rank", "w3", "cnt"]
