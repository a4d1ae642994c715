"""Operator 3, licence scans: Dice coefficient over word bigrams.

The larger units of a text are its lines, its paragraphs (between blank lines) and
the whole text; a unit equal to a smaller one isn't repeated.  Unit and
template are normalised to lower-case runs of letters and digits and compared
as sets of word bigrams by ``2 * shared / (a + b)``.

A notice inside a longer line or paragraph is found by smaller units: the
sentences of a paragraph (of one line or more), and every run of as many words
as a template has.  Of units of a paragraph that overlap only the best counts
(of equals a whole line or paragraph, then the longest, then the first), so a
notice that stands alone is not reported again.  To match, such a unit must
share ``b * t / (2 - t)`` bigrams with the template, hence at least one of any
``b - ceil(b * t / (2 - t)) + 1`` of them: only around those anchors, the
bigrams that fewest templates have, is anything compared.

Dice is at least ``t`` only if the sizes satisfy
``a * t / (2 - t) <= b <= a * (2 - t) / t``: units outside the bounds of all
templates are dropped before their bigrams are looked at, and a bigram that a
unit and a template share counts only within the pair's bounds.  The template
index (bigram to templates) is a table of fixed size in the code and is
broadcast; texts are not shuffled, only shared bigrams' counts are.  All of
it is built-in SQL functions; bigrams are compared by 64-bit hashes.

Defined cases: null text is empty; units of one word or none have no bigram
and match nothing; null ids are ids like others; rows of one id count as one
document, a unit of equal text, kind and number once; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.common import spread, text_or_empty
from gramloom.llm.license_texts import templates

THRESHOLD = 0.8
TOKEN = "[\\p{L}\\p{N}]+"


def _places(text: Column) -> Column:
    """Bigram hashes of a text by place."""
    return F.transform(F.sequence(F.lit(0), F.size(text) - 2), lambda i: F.xxhash64(F.get(text, i), F.get(text, i + 1)))


def _bigrams(text: Column) -> Column:
    """Distinct bigram hashes of a text."""
    return F.array_distinct(_places(text))


def _count(array: str) -> Column:
    """Size of an array, 0 for null.  (A size that may be null would make
    Catalyst add null filters, which it moves down and computes again.)"""
    return F.coalesce(F.size(array), F.lit(0))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_index(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    """``(h, template, license, b)``: bigrams of every template and its
    number of bigrams."""
    frame = spark.createDataFrame(rows, "template int, license string, t string")
    return (frame.select("template", "license", _words(F.col("t")).alias("w"))
            .select("template", "license", F.when(F.size("w") > 1, _bigrams(F.col("w"))).alias("g"))
            .select("template", "license", _count("g").alias("b"), F.explode_outer("g").alias("h")).filter("h is not null"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, no, w)``: words of every unit; ``no`` counts from 0
    within a kind."""
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")))
    numbered = ("transform(split(t, '{0}', -1), (x, i) -> struct('{1}' as kind, i as no, x as u))")
    lines = numbered.format("\\\\n", "line")
    paragraphs = f"filter({numbered.format('\\\\n[ \\\\t]*\\\\n', 'paragraph')}, x -> instr(x.u, '\\n') > 0)"
    whole = "if(t rlike '\\n[ \\t]*\\n', array(struct('text' as kind, 0 as no, t as u)), array())"
    each = rows.select("doc_id", F.explode_outer(F.expr(f"concat({lines}, {paragraphs}, {whole})")).alias("x"))
    return each.select("doc_id", "x.kind", "x.no", _words(F.col("x.u")).alias("w"))


def _anchored(spark: SparkSession, rows: list[tuple[int, str, str]], threshold: float) -> list[dict]:
    """Per template its distinct bigrams ``g`` and anchors ``x``, its number
    of places ``w`` and the least number of shared bigrams ``m``."""
    frame = spark.createDataFrame(rows, "template int, license string, t string").select(
        "template", "license", _words(F.col("t")).alias("w")).filter(F.size("w") > 1)
    got = frame.select("template", "license", "w", _places(F.col("w")).alias("g")).collect()  # fixed size
    common = Counter(h for r in got for h in set(r["g"]))
    out = []
    for r in got:
        length = {h: len(a) + len(b) for h, a, b in zip(r["g"], r["w"], r["w"][1:])}
        m = max(1, math.ceil(len(length) * threshold / (2 - threshold) - 1e-9))
        rare = sorted(length, key=lambda h: (common[h], -length[h], h))[:len(length) - m + 1]
        out.append({"template": r["template"], "license": r["license"], "g": sorted(length), "x": sorted(rare),
                    "w": len(r["g"]), "m": m, "far": int(len(length) * (2 - threshold) / threshold + 1e-9)})
    return out


def inner_matches(docs: DataFrame, rows: list[tuple[int, str, str]], threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Matches of the units inside lines and paragraphs, as :func:`matches`;
    ``no`` is the paragraph's number times 2^32 plus the first word's."""
    spark = docs.sparkSession
    index = _anchored(spark, rows, threshold)
    known = spark.createDataFrame([(r["template"], r["license"], r["g"], r["x"], r["w"], r["m"], r["far"]) for r in index],
                                  "i int, license string, tg array<long>, x array<long>, n int, m int, far int")

    def longs(hashes: list[int]) -> str:
        return f"cast(array({', '.join(f"'{h}'" for h in hashes)}) as array<bigint>)"
    anchors = longs(sorted({h for r in index for h in r["x"]}))
    each = f"array({', '.join(f'named_struct(\'i\', {r['template']}, \'x\', {longs(r['x'])})' for r in index)})"
    texts = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")))
    paragraphs = texts.select("doc_id", F.posexplode_outer(F.expr("split(t, '\\n[ \\t]*\\n', -1)")).alias("no", "t"))
    words = paragraphs.select("doc_id", "no", "t", _words(F.col("t")).alias("w"))
    placed = words.select("doc_id", "no", "t", F.when(F.size("w") > 1, _places(F.col("w"))).alias("g"))
    hits = placed.select("doc_id", "no", "t", "g", F.expr(f"array_intersect(g, {anchors})").alias("hits"))
    # explode_outer: for explode, Catalyst would add a filter that computes all of this once more.
    pairs = hits.select("doc_id", "no", "t", "g", F.explode_outer(F.expr(
        f"if(size(hits) > 0, transform(filter({each}, y -> arrays_overlap(y.x, hits)), y -> y.i), null)")).alias("i"))
    pairs = pairs.join(F.broadcast(known), "i")  # one row per template
    near = pairs.withColumn("near", F.expr(
        "filter(filter(sequence(0, size(g) - 1), k -> array_contains(x, g[k])), "
        "k -> size(array_intersect(slice(g, greatest(k - far, 0) + 1, 2 * far + 1), tg)) >= m)"))
    near = near.withColumn("at", F.explode_outer(F.expr("if(size(near) > 0, array(near), null)"))).filter("at is not null")
    # Ends of lines and sentences among the words: a mark's place less the marks before it.
    near = near.withColumn("tok", F.expr(f"regexp_extract_all(lower(t), '{_quoted(TOKEN)}|\\n|[.!?]+(?=\\s|$)', 0)"))
    near = near.withColumn("marks", F.expr(
        "filter(transform(tok, (y, k) -> struct(k, y)), z -> z.y rlike '^[.!?\\n]')"))
    near = near.withColumn("marks", F.expr("transform(marks, (z, k) -> struct(z.k - k as k, z.y = '\\n' as line))"))
    ends = "concat(array(0), transform(filter(marks, z -> {}), z -> z.k), array(size(g) + 1))"
    near = near.withColumn("lines", F.expr(ends.format("z.line"))).withColumn("sentences", F.expr(ends.format("not z.line")))
    parts = ("transform(sequence(1, size({0}) - 1), k -> struct({1} as rank, {0}[k - 1] as s, {0}[k] - 1 as e))")
    runs = ("if(size(g) > n, transform(array_distinct(flatten(transform(at, k -> "
            "sequence(greatest(0, k - n + 1), least(k, size(g) - n))))), k -> struct(1 as rank, k as s, k + n as e)), array())")
    near = near.withColumn("spans", F.expr(
        "filter(concat(array(struct(0 as rank, 0 as s, size(g) as e)), "
        f"{parts.format('lines', 0)}, {parts.format('sentences', 1)}, {runs}), "
        "y -> y.e > y.s and exists(at, k -> k >= y.s and k < y.e))"))
    scored = near.select("doc_id", "no", F.xxhash64("g").alias("unit"), "i", "license", F.expr(
        "transform(spans, y -> struct(2.0D * size(array_intersect(slice(g, y.s + 1, y.e - y.s), tg)) / "
        "(size(array_distinct(slice(g, y.s + 1, y.e - y.s))) + size(tg)) as dice, y.rank, y.s, y.e))").alias("spans"))
    found = (scored.select("doc_id", "no", "unit", "i", "license", F.explode_outer("spans").alias("y"))
             .filter(F.col("y.dice") >= threshold).groupBy("doc_id", "no", "unit")
             .agg(F.array_sort(F.collect_set(F.struct(
                 (-F.col("y.dice")).alias("less"), F.col("y.rank").alias("rank"), (F.col("y.s") - F.col("y.e")).alias("short"),
                 F.col("y.s").alias("s"), F.col("i").alias("template"), F.col("y.e").alias("e"), "license"))).alias("y")))
    best = found.withColumn("y", F.expr(
        "aggregate(y, slice(y, 1, 0), (kept, z) -> if(exists(kept, k -> k.s < z.e and z.s < k.e), kept, concat(kept, array(z))))"))
    return (best.select("doc_id", "no", F.explode_outer("y").alias("y")).filter("y.rank = 1")
            .select("doc_id", F.lit("inner").alias("kind"), F.expr("no * 4294967296 + y.s").alias("no"), "y.license",
                    "y.template", (-F.col("y.less")).alias("dice")))


def matches(docs: DataFrame, rows: list[tuple[int, str, str]] | None = None, threshold: float = THRESHOLD,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kind, no, license, template, dice)`` of every unit with a
    template of at least ``threshold``: its best one (of equals the first)."""
    rows = templates() if rows is None else rows
    whole = _whole_matches(docs, rows, threshold, id_col, text_col).withColumn("no", F.col("no").cast("long"))
    return whole.unionByName(inner_matches(docs, rows, threshold, id_col, text_col)) if rows else whole


def _whole_matches(docs: DataFrame, rows: list[tuple[int, str, str]], threshold: float, id_col: str,
                   text_col: str) -> DataFrame:
    """:func:`matches` of whole lines, paragraphs and texts."""
    index = template_index(docs.sparkSession, rows)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [r["b"] for r in index.select("b").distinct().collect()] or [0]  # at most one row per template
    # No filter on computed arrays: Catalyst would move it below their projections and compute them again.
    sized = units(docs, id_col, text_col).withColumn("g", F.when(
        F.size("w") - 1 >= max(1.0, min(sizes) * low - 1e-9), _bigrams(F.col("w"))))
    fitting = F.when(_count("g") <= max(sizes) * high + 1e-9, F.col("g"))
    # A unit can be told apart from the same one of another row of its id by its bigrams.
    shared = (sized.select("doc_id", "kind", "no", _count("g").alias("a"), F.xxhash64("g").alias("unit"),
                           F.explode_outer(fitting).alias("h"))
              .join(F.broadcast(index), "h")
              .filter((F.col("b") >= F.col("a") * low - 1e-9) & (F.col("b") <= F.col("a") * high + 1e-9))
              .groupBy("doc_id", "kind", "no", "unit", "a", "template", "license", "b")
              .agg(F.count_distinct("h").alias("n")))
    return (shared.withColumn("dice", 2.0 * F.col("n") / (F.col("a") + F.col("b")))
            .filter(F.col("dice") >= threshold).groupBy("doc_id", "kind", "no", "unit")
            .agg(F.max_by(F.struct("license", "template", "dice"), F.struct("dice", -F.col("template"))).alias("best"))
            .select("doc_id", "kind", "no", "best.*"))


def scan(docs: DataFrame, **params) -> DataFrame:
    """``(doc_id, license, dice, n_units)``: per document and licence the
    best coefficient and the number of matching units."""
    return (matches(docs, **params).groupBy("doc_id", "license")
            .agg(F.max("dice").alias("dice"), F.count_distinct("kind", "no").alias("n_units")))


def oracle() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, k, t in templates())
    return f"""
WITH tpl(template, license, t) AS (VALUES {values}),
tw AS (SELECT template, license, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM tpl),
tg AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS g
       FROM (SELECT template, license, w, unnest(range(1, len(w))) AS i FROM tw)),
tn AS (SELECT template, count(*) AS b FROM tg GROUP BY template),
u AS (SELECT doc_id, 'line' AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS t,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents
      UNION ALL
      SELECT * FROM (SELECT doc_id, 'paragraph' AS kind,
             unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n')) AS t,
             unnest(range(len(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n')))) AS no FROM documents)
      WHERE contains(t, chr(10))
      UNION ALL
      SELECT doc_id, 'text', text, 0 FROM documents WHERE regexp_matches(coalesce(text, ''), '\\n[ \\t]*\\n')),
uw AS (SELECT doc_id, kind, no, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM u),
ug AS (SELECT DISTINCT doc_id, kind, no, w[i] || ' ' || w[i + 1] AS g
       FROM (SELECT doc_id, kind, no, w, unnest(range(1, len(w))) AS i FROM uw)),
un AS (SELECT doc_id, kind, no, count(*) AS a FROM ug GROUP BY doc_id, kind, no),
m AS (SELECT doc_id, kind, no, template, license, count(*) AS n FROM ug JOIN tg USING (g)
      GROUP BY doc_id, kind, no, template, license),
d AS (SELECT doc_id, kind, no, license, template, 2.0::DOUBLE * n / (a + b) AS dice
      FROM m JOIN un USING (doc_id, kind, no) JOIN tn USING (template))
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT (kind, no)) AS n_units
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, no ORDER BY dice DESC, template) AS r
      FROM d WHERE dice >= 0.8)
WHERE r = 1 GROUP BY doc_id, license
"""
