"""SimHash near-duplicates against brute force."""
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gramloom.llm import simhash
from gramloom.llm.components import components
from tests.llm.data import awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps):
    """Component label of each fingerprint: positions of brute-force links."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    df = awkward(spark)
    rows = df.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    label = plain_classes(fps)
    best = {}
    for r, k in zip(rows, label):
        if r["doc_id"] is not None:
            best[k] = min(best.get(k, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f, best.get(k)) for r, f, k in zip(rows, fps, label))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_keep_one_leaves_one_row_of_each_class(spark):
    df = awkward(spark)
    classes = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    n = len(set(plain_classes([plain_fingerprint(r["text"]) for r in df.collect()])))
    kept = simhash.keep_one(df)
    assert kept.dtypes == df.dtypes
    rows = kept.collect()  # one id has texts of two classes
    assert len(rows) == n and {r["doc_id"] for r in rows} == classes


def test_rows_without_any_id(spark):
    df = documents(spark, ["same text of words here"] * 3 + ["b c d e f g h"], [None, None, None, None])
    assert simhash.keep_one(df).count() == 2
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {None}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_node_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 700))
    x = rng.integers(0, 1 << 63, 3, np.uint64)[rng.integers(0, 3, n)]
    for _ in range(seed % 7):
        x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    x = np.unique(x)
    g = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    x = x[np.argsort(g)]
    assert simhash.node_links(x, 4).tolist() == plain_classes([int(v) for v in x])


@pytest.mark.parametrize("limit", [3, 1 << 17])
def test_large_nodes_keep_every_link(spark, limit):
    rng = np.random.default_rng(5)
    x = np.full(150, 0x0123456789ABCDEF, np.uint64)
    for _ in range(3):
        x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    x = np.unique(np.r_[x, rng.integers(0, 1 << 63, 50, np.uint64)])
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(x.view(np.int64))], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, node_limit=limit).collect()}
    label = plain_classes([int(v) for v in x])
    assert [got[int(v)] for v in x.view(np.int64)] == label


def test_gray_rank_orders_by_one_bit_steps(spark):
    ranks = spark.range(256).select("id", simhash.gray_rank(F.col("id")).alias("r")).collect()
    order = [r["id"] for r in sorted(ranks, key=lambda r: r["r"])]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(order, order[1:]))


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame([*chain, *hub, (5000, 5000)], "u long, v long")
    rows = components(edges).collect()
    label = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(label) == 201 + 300
    assert len({label[k] for k in range(201)}) == 1 and len({label[1000 + k] for k in range(300)}) == 1
    assert label[0] != label[1000]
    assert components(edges.limit(0)).count() == 0
