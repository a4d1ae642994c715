"""Operator 4, benchmark decontamination: size-partitioned MinHash
containment search.

Which documents contain a test item, i.e. at least ``threshold`` of its
distinct five-word shingles?  A symmetric MinHash sketch cannot see thirty
shingles inside thousands, so the sketch is taken of the item: its shingles
of smallest hash, looked up among all shingles of each document.

* Items are partitioned by size, ``2^j`` to ``2^(j+1) - 1`` shingles.  The
  sketch length of a partition follows from its upper end ``u``:
  ``floor((1 - threshold) * u) + 1``.  A document that misses at most
  ``(1 - threshold)`` of an item's shingles cannot miss a whole sketch, so no
  link is lost.
* Candidate (document, item) pairs are those with a sketch shingle in common.
  They are verified on the shingles' words: the exact share of the item's
  distinct shingles that occur in the document.

Words are lower-cased runs of letters and digits.  Everything is built-in SQL
functions.  The items' tables are broadcast only if their counted rows (and
bytes, where they hold words) are few, otherwise the joins shuffle.

An item of fewer than five words is one shingle of its own length.  Documents
are cut into shingles of such a length too, but only if some item has it.

Defined cases: texts without a word (null ones too) have no shingle, so such
items are not searched and such documents match nothing; repeated items
and documents count once per id, with the best containment among rows of one
id; null ids are ids like others; empty tables give an empty result; extra
columns are ignored, and kept by :func:`remove_leaks`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import fresh, spread, stored, text_or_empty
from gramloom.session import broadcast_bound, maybe_broadcast

SHINGLE = 5
THRESHOLD = 0.8
TOKEN = "[\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _shingles(rows: DataFrame, keep: list[str], k: int, with_words: bool) -> DataFrame:
    """One row per shingle of the word array ``w``: ``keep``, ``h`` and,
    if asked, its words ``s``."""
    parts = ", ".join(f"get(w, i + {j})" for j in range(k))
    spots = rows.filter(f"size(w) >= {k}").select(*keep, "w", F.explode(F.expr(f"sequence(0, size(w) - {k})")).alias("i"))
    more = [F.expr(f"concat_ws(' ', {parts})").alias("s")] if with_words else []
    return spots.select(*keep, F.expr(f"xxhash64({parts})").alias("h"), *more)


def _of_lengths(rows: DataFrame, keep: list[str], lengths: list[int], with_words: bool) -> DataFrame:
    """:func:`_shingles` of every length."""
    return reduce(DataFrame.unionAll, [_shingles(rows, keep, k, with_words) for k in lengths])


def item_shingles(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """Distinct shingles of every item: ``(item_id, item, words, h, s, n,
    sketch)``; ``item`` tells rows of one id and different texts apart,
    ``words`` is the shingles' length (the item's own if that is below
    ``k``), ``n`` the item's number of shingles, ``sketch`` marks those of
    its sketch."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), text_or_empty(text_col).alias("t"))
    rows = rows.select("item_id", F.xxhash64("t").alias("item"), _words(F.col("t")).alias("w"))
    rows = rows.withColumn("words", F.least(F.size("w"), F.lit(k)))
    one = reduce(DataFrame.unionAll, [_shingles(rows.filter(f"words = {m}"), ["item_id", "item", "words"], m, True)
                                      for m in range(1, k + 1)]).distinct()
    sizes = one.groupBy("item_id", "item").agg(F.count(F.lit(1)).alias("n"))
    upper = "shiftleft(1L, cast(floor(log2(n)) as int) + 1) - 1"
    sizes = sizes.withColumn("k", F.expr(f"cast(floor((1 - {threshold}D) * ({upper}) + 1e-9D) as bigint) + 1"))
    # An item's shingles, ranked by hash: the group is one test item.
    ranked = (one.join(sizes.select(F.col("item_id").alias("a"), F.col("item").alias("b"), "n", "k"),
                       F.col("item_id").eqNullSafe(F.col("a")) & (F.col("item") == F.col("b")))
              .withColumn("r", F.expr("row_number() over (partition by item_id, item order by h, s)")))
    return ranked.select("item_id", "item", "words", "h", "s", "n", (F.col("r") <= F.col("k")).alias("sketch"))


def containments(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, item_id, n_shingles, n_found)`` of every
    document text and item with ``n_found >= threshold * n_shingles``."""
    index = stored(item_shingles(items, k, threshold), "items")
    rows = index.count()
    lengths = sorted(r["words"] for r in index.select("words").distinct().collect()) or [k]  # at most k
    texts = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")))
    base = texts.select("doc_id", F.xxhash64("t").alias("text_hash"), _words(F.col("t")).alias("w"))
    probes = index.filter("sketch").select("h", F.col("item_id").alias("c_item_id"), F.col("item").alias("c_item"))
    found = (_of_lengths(base, ["doc_id", "text_hash"], lengths, False).join(maybe_broadcast(probes, rows), "h")
             .select("doc_id", "text_hash", "c_item_id", "c_item").distinct())
    pairs = stored(found, "candidates")
    wanted = pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("th")).distinct()
    few = pairs.count()
    again = base.join(maybe_broadcast(wanted, few),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("th")), "left_semi")
    full = maybe_broadcast(index.select(F.col("h").alias("ih"), F.col("s").alias("is"), "item_id", "item", "n"),
                           broadcast_bound(index, "s"))
    hits = (_of_lengths(again, ["doc_id", "text_hash"], lengths, True)
            .join(full, (F.col("h") == F.col("ih")) & (F.col("s") == F.col("is")))
            .select("doc_id", "text_hash", "item_id", "item", "n", "s").distinct())
    counted = (hits.groupBy("doc_id", "text_hash", "item_id", "item", "n").agg(F.count(F.lit(1)).alias("n_found")))
    return (counted.filter(F.col("n_found") >= F.lit(threshold) * F.col("n") - F.lit(1e-9))
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max(F.struct((F.col("n_found") / F.col("n")).alias("c"), F.col("n_found"), F.col("n"))).alias("b"))
            .select("doc_id", "text_hash", "item_id", F.col("b.n").alias("n_shingles"), F.col("b.n_found").alias("n_found")))


def leaks(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` of each
    document id and item id."""
    return (containments(docs, items, **params).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found"))
                 .alias("b"))
            .select("doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment"))


def remove_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **params) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = stored(containments(docs, items, id_col=id_col, text_col=text_col, **params)
                 .select(F.col("doc_id").alias("bad_doc"), F.col("text_hash").alias("bad_text")).distinct(), "leaks")
    key = fresh(docs, "text_hash")
    return (spread(docs).withColumn(key, F.xxhash64(text_or_empty(text_col)))
            .join(maybe_broadcast(bad, bad.count()), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("bad_doc"))
                  & (F.col(key) == F.col("bad_text")), "left_anti").drop(key))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
b0 AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(len(w), 5) AS m FROM b0 WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
