"""Quality rules and toxicity."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from gramloom.llm import quality, toxicity
from tests.llm.data import awkward, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def junk(rng):
    return " | ".join("w%d" % rng.randrange(400) for _ in range(120))


@pytest.fixture(scope="module")
def judged_rows(spark):
    rng = random.Random(4)
    good = [prose(rng, 150) for _ in range(60)]
    bad = [junk(rng) for _ in range(30)]
    more = awkward(spark)
    df = documents(spark, good + bad).unionByName(more.withColumn("doc_id", more["doc_id"] + 1000))
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(k, 0) for k in range(60, 80)] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    return df, labels


def test_base_counts(judged_rows):
    df, labels = judged_rows
    want = sorted((str(r["doc_id"]), *base(r["text"])) for r in df.collect())
    got = quality.quality(df, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"]) for r in got) == want


def test_verdicts_keep_good_and_drop_junk(judged_rows):
    df, labels = judged_rows
    got = {r["doc_id"]: r["kept"] for r in quality.quality(df, labels).collect() if r["doc_id"] is not None}
    assert all(got[k] for k in range(60)) and not any(got[60 + k] for k in range(30))
    kept = quality.keep_good(df, labels)
    assert kept.dtypes == df.dtypes
    assert {r["doc_id"] for r in kept.collect()} >= set(range(60))


def test_scores_equal_brute_force(judged_rows):
    df, labels = judged_rows
    bounded = quality.labelled_ids(labels)
    fit = {r["label_id"] for r in bounded.filter("good and fit").collect()}
    b = 64

    def features(t):
        w = re.findall(r"[^\W]+|[^\w\s]+", (t or "").lower())
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        # Spark chains columns: the hash of the first seeds the second.
        pairs = [xxhash.xxh64_intdigest(y.encode(), a) for a, y in zip(h, w[1:])]
        return [((x + (1 << 63)) % (1 << 64) - (1 << 63)) % b for x in h + pairs]
    rows = [r for r in df.collect()]
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(features(r["text"]))
        if r["doc_id"] in fit:
            target.update(features(r["text"]))
    ratio = [math.log((target[k] + 1) / (sum(target.values()) + b)) - math.log((raw[k] + 1) / (sum(raw.values()) + b))
             for k in range(b)]
    got = sorted(round(r["llr"], 4) for r in quality.quality(df, labels, buckets=b).collect())
    want = sorted(round(float(np.mean([ratio[f] for f in fs])), 4) if (fs := features(r["text"])) else 0.0 for r in rows)
    assert np.allclose(got, want, atol=2e-4)


def test_quality_of_empty_tables(spark):
    labels = empty(spark, "doc_id long, quality int")
    assert quality.quality(empty(spark), labels).count() == 0
    rows = quality.quality(documents(spark, [prose(random.Random(1), 100), None]), labels).collect()
    assert [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [True, False]


def test_threshold_sits_in_the_widest_best_gap():
    assert quality.threshold([(0.1, False), (0.2, False), (0.8, True), (0.9, True)]) == 0.5
    assert quality.threshold([(0.1, True)]) == 0.0
    assert quality.threshold([]) == 0.0


def test_every_label_takes_part(spark):
    labels = spark.range(20_500).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality.labelled_ids(labels).count() == 20_500


def test_threshold_of_a_table_equals_that_of_a_list(spark):
    rng = random.Random(3)
    cases = [[], [(0.1, True)], [(0.1, False)], [(0.2, True), (0.2, False)], [(0.5, True), (0.1, False), (0.5, False)]]
    cases += [[(rng.choice([round(rng.gauss(k % 2, 1), 2), rng.gauss(k % 2, 1)]), k % 2 == 1) for k in range(n)] for n in (7, 3000)]
    for rows in cases:
        got = quality.threshold_of(spark.createDataFrame(rows, "s double, good boolean"))
        assert got == quality.threshold(rows)


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(500):
        t, bad = prose(rng, rng.randrange(40, 200)), k % 4 == 0
        if bad:
            lines = t.split("\n")
            lines[rng.randrange(len(lines))] += " You are %s." % rng.choice(["vileling", "vilesome", "grotten"])
            t = "\n".join(lines)
        rows.append(t)
        if k < 400:
            labels.append((k, int(bad)))
    df = documents(spark, rows + [None, "", "!!!"], [*range(500), 500, 501, None])
    return df, spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, toxic int"), rows


def test_toxicity_on_held_out_documents(toxic_docs):
    df, labels, texts = toxic_docs
    model = toxicity.train(df, labels)
    rows = toxicity.score(df, model).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 503 and all(0 <= r["score"] <= 1 for r in rows)
    assert score[500] == score[501] == score[None] == 0
    right = sum((score[k] >= 0.5) == (k % 4 == 0) for k in range(400, 500))
    assert right >= 97
    for r in rows:  # the offending sentence is the one with the insult
        if r["doc_id"] is not None and 400 <= r["doc_id"] < 500 and r["score"] >= 0.5 and r["doc_id"] % 4 == 0:
            assert any(re.search("viles|grotten|vileling", texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["offending"])


def test_long_clean_texts_are_not_toxic(toxic_docs):
    df, labels, texts = toxic_docs
    weights, bias = toxicity.train(df, labels)
    scorer = toxicity.Scorer(weights, bias)
    clean = "\n".join(t for k, t in enumerate(texts) if k % 4)
    clean = "\n".join([clean] * (1_000_000 // len(clean) + 1))
    assert len(clean) >= 1_000_000 and scorer.score(clean) < 0.1 and scorer.locate(clean, 0.5) == []
    assert scorer.score(clean + "\nYou are vilesome.") >= 0.5
    plain = "Nothing here. " * 80_000  # no feature at all
    assert scorer.score(plain) == 0


def test_every_positive_text_has_offending_sentences():
    """Weak sentences that add up: the strongest that reach it together."""
    weak, mild = (zlib.crc32(f"^{w}$".encode()) for w in ("weak", "mild"))
    s = toxicity.Scorer({weak: 4.0, mild: 2.0}, -5.0)
    text = "All fine. So mild. So weak! Nothing. Weak, weak. " + "A weak one. " * 2
    by = [0.0 - math.expm1(s.floor - math.log1p(math.exp(z))) for z in (-1.0, 3.0)]
    got = s.locate(text, 0.5)  # one sentence is enough by itself
    assert [text[x["start"]:x["end"]].strip() for x in got] == ["Weak, weak"] and got[0]["score"] == pytest.approx(by[1])
    text = "All fine. So mild. So weak! Nothing. " + "A weak one. " * 3
    assert s.score(text) >= 0.5 > by[0]
    got = s.locate(text, 0.5)
    assert [text[x["start"]:x["end"]].strip() for x in got] == ["So weak", "A weak one", "A weak one"]
    assert 1 - math.prod(1 - x["score"] for x in got) >= 0.5 > 1 - math.prod(1 - x["score"] for x in got[:2])
    assert s.locate("So weak! So mild.", 0.5) == [] and s.locate("", 0.5) == []


def test_whole_long_texts_are_sampled(spark):
    rng = random.Random(9)
    rows = [prose(rng, 30_000), prose(rng, 50) + " vilesome.", prose(rng, 50)]
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(40)], "doc_id long, toxic int")
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5][:3]
    got = toxicity.sample(documents(spark, rows, ids), labels).collect()
    assert sorted(len(r["t"]) for r in got) == sorted(map(len, rows)) and len(rows[0]) > 100_000


def test_held_out_labels_are_not_read(toxic_docs, spark):
    import zlib
    df, labels, _ = toxic_docs
    flipped = spark.createDataFrame([(r["doc_id"], 1 - r["toxic"] if r["doc_id"] is not None and r["toxic"] is not None
                                      and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["toxic"])
                                     for r in labels.collect()], labels.schema)
    assert toxicity.train(df, labels) == toxicity.train(df, flipped)


def test_noisy_or_and_empty_labels(spark):
    s = toxicity.Scorer({}, -1.0)
    p = 1 / (1 + math.exp(1))
    assert s.score("One. Two! ... Three?") == pytest.approx(1 - (1 - p) ** 3)
    assert s.score("") == 0
    none = empty(spark, "doc_id long, toxic int")
    assert toxicity.train(documents(spark, ["a b"]), none) == ({}, toxicity.PRIOR)
    assert toxicity.score(empty(spark), ({}, -6.0)).count() == 0
