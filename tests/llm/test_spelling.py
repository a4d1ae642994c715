"""Spelling variants against brute force."""
import collections
import random
import re
import zlib

import numpy as np
import pytest

from gramloom.llm import spelling
from tests.llm.data import CLASH, awkward

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SCHEMA = f"doc_id long, text string, {CLASH}, word string, n long, a long, pairs long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *[0] * 5, "b", 0, 0, 0, 0, "w", 1, 2, 3) for i, t in rows], SCHEMA)


def plain_counts(rows):
    out = collections.Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_groups(rows):
    n = plain_counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def rows_of(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def edited(rng, w, letters):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + rng.choice(letters) + w[k:]])


def corpus(seed=0, n=40, letters="abcdeêßÿ×Z"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for w in base:
            words += [w] * rng.randrange(0, 12)
            if rng.random() < 0.7:
                words.append(edited(rng, w, letters))
            if rng.random() < 0.3:
                words.append(edited(rng, edited(rng, w, letters), letters))
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", "-", "\n", "1"]).join(words)))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (90, None), (91, ""), (92, " \n"), (93, "aaaaaaaa aaaaaaa " * 30)]


@pytest.mark.parametrize("limit,sizes", [(4096, None), (1, [2, 5, 90]), (0, [1, 90])])
def test_groups_equal_brute_force(spark, limit, sizes):
    rows = corpus()
    assert rows_of(spelling.group_variants(table(spark, rows), pair_limit=limit, sizes=sizes)) == plain_groups(rows)


def test_awkward_documents(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(spelling.group_variants(df)) == plain_groups(rows)
    assert rows_of(spelling.group_variants(df.limit(0))) == []


def test_chains_of_forms_and_salted_roots(spark, monkeypatch):
    """b -> a -> root: each ten times as frequent as the one before."""
    words = ["abcdefgh", "abcdefgi", "abcdefhi"]
    text = " ".join(words[k] for k, n in enumerate((2, 40, 800)) for _ in range(n))
    rows = [(5, text)]
    if len(plain_counts(rows)) == 3:
        want = plain_groups(rows)
        assert rows_of(spelling.group_variants(table(spark, rows))) == want
        monkeypatch.setattr(spelling, "BROADCAST_ROW_LIMIT", 0)
        assert rows_of(spelling.group_variants(table(spark, rows))) == want
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], "word string, form string")
    monkeypatch.setattr(spelling, "BROADCAST_ROW_LIMIT", 0)
    assert {r["word"]: r["root"] for r in spelling.roots(chain).collect()} == dict.fromkeys("abcx", "d")


def test_very_long_words(spark):
    """Two words of 20,000 letters one edit apart, and many equal letters."""
    rng = random.Random(2)
    w = "".join(rng.choice("abcdefgh") for _ in range(20000))
    v = w[:9000] + ("x" if w[9000] != "x" else "y") + w[9001:]
    rows = [(1, f"{w} {w} {v} {v} {'a' * 5000} {'a' * 5000} {'a' * 5001} {'a' * 5001}")]
    assert rows_of(spelling.group_variants(table(spark, rows))) == plain_groups(rows)


def test_one_bucket_of_many_words_is_split(spark):
    """Words that one coarse symbol makes equal never expand to all pairs."""
    rng = random.Random(4)
    words = list({"".join(rng.choice(spelling.LETTERS) for _ in range(8)) for _ in range(400)})
    rows = [(1, " ".join(words + words + [edited(rng, w, "abc") for w in words[:50]] * 2))]
    counts = spark.createDataFrame(list(plain_counts(rows).items()), "word string, n long")
    links = spelling._links(counts, spelling.alphabet(1))
    assert max(r["pairs"] for r in links.collect()) > 100_000
    got = {(r["word"], r["near"]) for r in spelling.near_words(counts, 100, [1, 90]).collect()}
    n = sorted(plain_counts(rows))
    assert got == {(a, b) for a in n for b in n if a < b and one_edit(a, b)}


@pytest.mark.parametrize("length", [1, 2, 5])
def test_neighbourhoods_are_complete(length):
    """From one side or the other, every pair of words over three symbols."""
    import itertools
    symbols = np.array([97, 98, 99], np.uint64)
    words = ["".join(w) for n in (length, length + 1) for w in itertools.product("abc", repeat=n)]
    code = lambda w: np.array([[ord(c) for c in w]], np.uint64)
    key = {w: int(spelling.fingerprints(code(w))[0]) for w in words}
    made = {w: [int(k) for _, ks in spelling.neighbours(code(w), symbols) for k in ks] for w in words}
    for a, b in itertools.combinations(words, 2):
        hits = made[a].count(key[b]) + made[b].count(key[a])
        assert hits == int(one_edit(a, b))
