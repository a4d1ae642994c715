"""Exact search and vector codes against brute force."""
import hashlib
import math
import random

import numpy as np
import pytest

from gramloom.llm import codes, search
from gramloom.llm.vectors import products

CLASH = "row long, r double, pivot int, ring int, sub int, x binary, at binary, dist binary, v string, n long"
SCHEMA = f"vec_id long, embedding array<float>, label int, {CLASH}"
DIM = 8


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 1.0, 1, 1, 1, b"x", b"a", b"d", "v", 1) for i, v, lab in rows], SCHEMA)


def awkward_rows(seed=0, n=150):
    rng = random.Random(seed)
    vec = lambda: [float(np.float32(rng.uniform(-1, 1))) for _ in range(DIM)]
    rows = [(i, vec(), rng.choice([None, 0, 1, 2])) for i in range(n)]
    same = vec()
    rows += [(1000 + i, same, 7) for i in range(80)]                 # a large group of copies: ties everywhere
    rows += [rows[0], rows[50], (50, vec(), 3), (None, vec(), 1)]    # repeated rows, one id twice, no id
    rows += [(2000, None, 1), (2050, [None] * DIM, 1), (2100, [math.nan] + same[1:], 1),
             (2150, [math.inf] + same[1:], 1), (2200, [0.0] * DIM, None)]
    return rows


def integers(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_top_k(rows, every, k=5):
    out = []
    kept = [(i, x) for i, x, _ in integers(rows, 256) if i is not None]
    for i, q in kept:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in kept if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("size", [dict(pivots=4, rings=8, block=8, group=3), dict()])
def test_search_equals_brute_force(spark, size):
    rows = awkward_rows()
    got = search.top_k(table(spark, rows), every=10, **size).collect()
    assert sorted(tuple(r) for r in got) == plain_top_k(rows, 10)


def test_search_of_few_and_no_rows(spark):
    rows = awkward_rows()[:3]
    got = search.top_k(table(spark, rows), every=1).collect()
    assert sorted(tuple(r) for r in got) == plain_top_k(rows, 1)
    assert search.top_k(table(spark, [])).collect() == []
    assert search.top_k(table(spark, [(2000, None, 1)])).collect() == []
    one = table(spark, [(0, [1.0] * DIM, None)])
    assert search.top_k(one).collect() == []


def test_search_skips_annuli_out_of_reach():
    """Bounds never exceed the true distance, and far annuli are left out."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (10, 16))
    x = np.concatenate([c + rng.integers(-5, 6, (100, 16)) for c in centres])
    space = search.Space(np.zeros((0, 0)), int((x * x).sum(1).max()), 16)
    space.pivots = search.fit_pivots(x, space.top, 10)
    d = space.distances(x)
    at, q = d.argmin(1), x[::100]
    true = np.sqrt(np.maximum((q * q).sum(1)[:, None] + space.top - 2 * products(q, x), 0))
    bound = np.abs(space.distances(q, True)[:, at] - d[np.arange(len(x)), at])
    assert (bound <= true + space.slack).all()
    kth = np.sort(true, 1)[:, 5]
    assert (bound > kth[:, None] + space.slack).mean() > 0.3


def test_vectors_of_different_lengths_are_refused(spark):
    rows = [(0, [1.0] * DIM, 1), (1, [1.0] * (DIM + 4), 1)]
    with pytest.raises(ValueError, match="different lengths"):
        search.top_k(table(spark, rows))
    with pytest.raises(Exception, match="different lengths"):
        codes.compress(table(spark, rows))
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(table(spark, [(0, [1.0] * 7, 1)]))


def test_products_are_exact_beyond_doubles():
    a = np.array([[1 << 29, 3]], np.int64)
    assert products(a, a)[0, 0] == (1 << 58) + 9


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry in every round."""
    kept = integers(rows, 1024)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    width = DIM // parts
    cut = lambda x, p: x[p * width:(p + 1) * width]
    books = [[list(cut(kept[k][1], p)) for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, x, _ in kept:
            best = [min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e)), k) for k, e in enumerate(books[p]))
                    for p in range(parts)]
            out.append(best)
        return out
    for _ in range(rounds):
        a = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(kept[r][1], p) for r in range(len(kept)) if a[r][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    a = assign()
    errors = [sum(d for d, _ in r) for r in a]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in r), e, by_label[lab])
                  for (i, _, lab), r, e in zip(kept, a, errors)), digest


@pytest.mark.parametrize("entries", [16, 256])
def test_codes_equal_brute_force(spark, entries):
    rows = awkward_rows(3)
    coded, books = codes.compress(table(spark, rows), entries=entries)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"])
                 for r in codes.with_label_errors(coded).collect())
    want, digest = plain_codes(rows, entries=entries)
    assert got == want
    assert books.digest() == digest


def test_codes_of_an_empty_table(spark):
    coded, books = codes.compress(table(spark, [(1, None, 2)]))
    assert coded.collect() == [] and books is None
    assert codes.with_label_errors(coded).collect() == []


def test_label_errors_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROW_LIMIT", 0)
    df = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3, "00", k) for k in range(50)],
                               "vec_id long, label int, code string, error long")
    got = {r["vec_id"]: r["label_error"] for r in codes.with_label_errors(df).collect()}
    assert got == {k: sum(j for j in range(50) if j % 3 == k % 3) for k in range(50)}


def test_reassign_equals_a_full_scan():
    rng = np.random.default_rng(0)
    x = rng.integers(-6, 6, (500, 3))
    old = rng.integers(-6, 6, (20, 3))
    at, dist = codes.nearest(x, old)
    for share in (0.0, 0.2, 1.0):
        moved = rng.random(20) < share
        new = np.where(moved[:, None], rng.integers(-6, 6, (20, 3)), old)
        a, d = codes.reassign(x, new, moved, at, dist)
        b, e = codes.nearest(x, new)
        assert (a == b).all() and (d == e).all()
