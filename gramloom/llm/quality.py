"""Operator 8, quality rules: length-normalised n-gram log-likelihood ratio.

Features of a text are its lower-cased tokens (runs of letters and digits, runs
of other marks) and pairs of neighbouring tokens, hashed into ``buckets``
buckets.  Two multinomials over the buckets are counted: ``raw`` over every
document of the corpus, ``target`` over trusted documents (label 1 of one half
of the given labels).  A document scores the mean over its features of
``log p_target(bucket) - log p_raw(bucket)`` (add-one smoothing), so the
score does not depend on its length.  One threshold decides for every
document: the cut between the scores of good and bad documents of the other
half of the labels that errs least on them, in the middle of the widest such
gap.  (Documents counted in the target would score too well to place it.)

Every label takes part: the ids of trusted documents are broadcast behind
their counted rows and joined by a shuffle beyond.  Each document is scored
once; the scores are stored, and those of the other half's labels are ranked
over the cluster to find the cut.  Work on texts is built-in SQL functions, in
the task that scans them: only bucket counts and scores are shuffled.

Base rules come first: a document of fewer than 50 words, or with over half
its words inside repeated three-word windows, fails.  Windows are compared by
a 64-bit hash.

Defined cases: null text is empty (no words, fails the base rules); without
labels of both kinds the threshold is 0, without trusted documents the target
is uniform over what was seen; a null id matches no label; repeated rows are
judged alike; several labels of one id count as bad if any is bad; extra
columns are kept by :func:`keep_good` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import WORD, fresh, spread, stored, text_or_empty, words_of
from gramloom.session import maybe_broadcast

BUCKETS = 1 << 12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def labelled_ids(labels: DataFrame) -> DataFrame:
    """All labelled ids ``(label_id, good, fit)``; ``fit`` marks the half
    whose good documents make the target."""
    return (labels.filter("doc_id is not null and quality is not null")
            .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") == 1).alias("good"))
            .withColumn("fit", F.xxhash64("label_id", F.lit("fit")) % 2 == 0))


def _bucket(parts: str, buckets: int) -> str:
    return f"cast(pmod(xxhash64({parts}), {buckets}L) as int)"


def feature_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(bucket, raw, target)`` over all documents; ``labels`` is the table
    of :func:`labelled_ids`."""
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), text_or_empty(text_col).alias("text")))
    good = labels.filter("good and fit").select("label_id", "good")
    rows = (rows.join(maybe_broadcast(good, good.count()), "label_id", "left")
            .select(tokens_of(F.col("text")).alias("w"), F.coalesce("good", F.lit(False)).alias("good")))
    spots = (rows.filter("size(w) > 0")
             .select("w", "good", F.explode(F.expr("sequence(0, size(w) - 1)")).alias("i")))
    feats = spots.select("good", F.explode(F.expr(
        f"array({_bucket('get(w, i)', buckets)}, "
        f"if(i + 1 < size(w), {_bucket('get(w, i), get(w, i + 1)', buckets)}, -1))")).alias("bucket"))
    return (feats.filter("bucket >= 0").groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target")))


def weights(counts: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket (``buckets`` numbers, on the driver)."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most `buckets` rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw) + buckets, sum(target) + buckets
    if all_target == buckets:
        target, all_target = raw, all_raw
    return [round(math.log((t + 1) / all_target) - math.log((r + 1) / all_raw), 6) for r, t in zip(raw, target)]


def llr(words: str, log_ratios: list[float]) -> Column:
    """Mean log ratio over the features of the token array column ``words``
    (0 without tokens)."""
    b = len(log_ratios)
    table = f"cast(split('{','.join(map(str, log_ratios))}', ',') as array<double>)"
    one, two = _bucket(f"get({words}, i)", b), _bucket(f"get({words}, i), get({words}, i + 1)", b)
    return F.expr(
        f"if(size({words}) = 0, 0D, (aggregate(sequence(0, size({words}) - 1), 0D, (a, i) -> a + get({table}, {one}))"
        f" + if(size({words}) = 1, 0D, aggregate(sequence(0, greatest(size({words}) - 2, 0)), 0D, "
        f"(a, i) -> a + get({table}, {two})))) / (2 * size({words}) - 1))")


def threshold(scored: list[tuple[float, bool]]) -> float:
    """The cut between scores of bad (below) and good documents with the
    fewest errors; of equal cuts the one in the widest gap, its middle."""
    goods = sum(g for _, g in scored)
    if goods in (0, len(scored)):
        return 0.0
    scored = sorted(scored)
    errors, best = len(scored) - goods, None
    for (s, g), (t, _) in zip(scored, scored[1:]):
        errors += 1 if g else -1
        if t > s and (best is None or (errors, s - t) < best[0]):
            best = ((errors, s - t), (s + t) / 2)
    return 0.0 if best is None else best[1]


def threshold_of(scored: DataFrame) -> float:
    """:func:`threshold` of a table ``(s, good)`` of any size.

    Equal scores are one row.  Rows are cut into ranges of scores; a range
    counts its own errors in parallel, and of every range only one row (at
    most 1,025) comes to the driver."""
    from gramloom.sources.lines import _key_ranges
    per = scored.groupBy("s").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    per = stored(_key_ranges(per, "s", 1024), "cut")
    ranges = sorted(tuple(r) for r in per.groupBy("_b").agg(F.sum("g"), F.sum("b"), F.min("s")).collect())
    goods, bads = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    if not goods or not bads:
        return 0.0
    before, errors = [], bads
    for (no, g, b, _), after in zip(ranges, [*ranges[1:], None]):
        before.append((no, errors, after and after[3]))
        errors += g - b
    w = Window.partitionBy("_b").orderBy("s")
    cuts = (per.join(F.broadcast(per.sparkSession.createDataFrame(before, "_b int, errors long, after double")), "_b")
            .select("s", F.coalesce(F.lead("s").over(w), F.col("after")).alias("t"), (F.col("errors") + F.sum(F.col("g") - F.col("b")).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("errors")))
    best = cuts.filter("t is not null").agg(F.min(F.struct("errors", F.col("s") - F.col("t"), "s", "t")).alias("x")).first()["x"]
    return 0.0 if best is None else (best["s"] + best["t"]) / 2


def base_columns(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with the base counts under the given column names; ``text``
    is a column without nulls, ``names["words"]`` its word array."""
    w, h, s, pos = (names[k] for k in ("words", "windows", "sorted", "spots"))
    out = docs.withColumn(w, words_of(F.col(text)))
    lines = fresh(out, "lines")
    out = out.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    out = out.withColumns({
        names["n_words"]: F.size(w).cast("long"),
        names["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
        names["n_symbols"]: F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        h: F.expr(f"if(size({w}) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size({w}) - 3, 0)), "
                  f"i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))")}).drop(lines)
    # Only a text with a repeated window needs its windows sorted.
    out = out.withColumn(s, F.expr(
        f"if(size(array_distinct({h})) < size({h}), sort_array(transform({h}, (x, i) -> struct(x as x, i as i))), "
        f"cast(array() as array<struct<x:bigint,i:int>>))")).drop(h)
    out = out.withColumn(pos, F.expr(
        f"sort_array(transform(filter({s}, (e, k) -> coalesce(get({s}, k - 1).x = e.x, false) "
        f"or coalesce(get({s}, k + 1).x = e.x, false)), e -> e.i))")).drop(s)
    return out.withColumn(names["n_repeat_words"], F.expr(
        f"cast(aggregate({pos}, named_struct('n', 0, 'to', 0), (a, p) -> named_struct("
        f"'n', a.n + p + 3 - greatest(p, a.to), 'to', p + 3), a -> a.n) as bigint)")).drop(pos)


TOKEN = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
           max_repeat_percent: int = MAX_REPEAT_PERCENT, id_col: str = "doc_id", text_col: str = "text",
           want: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts, ``llr``, ``base_failed`` and ``kept``, or
    its columns ``want`` and these; the second result maps the names to the
    columns they have (another name where ``docs`` already has one like it)."""
    known = labelled_ids(labels).cache()
    ratios = weights(feature_counts(docs, known, buckets, id_col, text_col), buckets)
    names: dict[str, str] = {}
    taken = spread(docs)
    for k in ("text_", "words", "windows", "sorted", "spots", "key", *COUNTS, "llr", "base_failed", "kept"):
        names[k] = fresh(taken, f"{k}")
        taken = taken.withColumn(names[k], F.lit(0))
    out = base_columns(spread(docs).withColumn(names["text_"], text_or_empty(text_col)), names["text_"], names)
    n, rep = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    # The word array's column now takes the tokens.
    out = out.withColumn(names["words"], tokens_of(F.col(names["text_"])))
    out = out.withColumn(names["llr"], llr(names["words"], ratios)).drop(names["words"], names["text_"])
    out = out.withColumn(names["base_failed"], (n < min_words) | (100 * rep > max_repeat_percent * n))
    out = out.withColumn(names["key"], F.col(f"`{id_col}`").cast("long"))
    out = stored(out.select(*[F.col(f"`{c}`") for c in (docs.columns if want is None else want)],
                            *[names[k] for k in ("key", *COUNTS, "llr", "base_failed")]), "judged", "zstd")
    scored = out.filter(n >= min_words).select(F.col(names["key"]).alias("label_id"), F.col(names["llr"]).alias("s"))
    cut = threshold_of(scored.join(known.filter("not fit"), "label_id").select("s", "good"))
    return (out.drop(names["key"])
            .withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["llr"]) >= cut)), names)


def quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr, base_failed, kept)`` of every document."""
    id_col, text_col = params.pop("id_col", "doc_id"), params.pop("text_col", "text")
    rows, names = judged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                         labels, want=("doc_id",), **params)
    return rows.select("doc_id", *[F.col(names[k]).alias(k) for k in (*COUNTS, "llr", "base_failed", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    rows, names = judged(docs, labels, **params)
    return rows.filter(names["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
