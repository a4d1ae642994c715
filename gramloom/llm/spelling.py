"""Operator 12, spelling variant grouping: reduced-alphabet generation.

1. **Words.**  Counted over all texts by built-in functions.
2. **Reduced words.**  A hash maps every letter to one of a few symbols, so a
   vocabulary shrinks to reduced words, each the bucket of its words.  Two
   words within one edit have reduced words within one edit (or equal).
3. **Neighbourhoods.**  Each distinct reduced word generates its full one-edit
   neighbourhood.  Neighbourhoods are symmetric, so every pair of reduced
   words is taken from one side only: an insertion as the deletion in the
   longer one, a replacement from the lower fingerprint.  A neighbour travels
   as a 64-bit polynomial fingerprint, made from the word's prefix and suffix
   sums, so a word of a million letters costs a million numbers, not a
   million words.
4. **Join.**  Neighbours meet the reduced vocabulary by fingerprint; linked
   buckets give candidate pairs, and the original strings decide (edit
   distance exactly 1).  Equal fingerprints of different words only add
   candidates.
5. **Large buckets.**  Bucket pairs with more than ``PAIR_LIMIT`` pairs of words
   are not expanded: their words go through steps 2 to 4 again with a finer
   alphabet, at last with all letters, where a bucket is one word.

Defined cases: a null text has no word; a null document id is written as
empty text before the colon of the rule; repeated rows count as often as they
occur; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import crc32_text, ship_package, spread, stored, text_or_empty
from gramloom.session import BROADCAST_ROW_LIMIT

MIN_LENGTH = 7
MIN_COUNT = 2
# A near word is a word's form if it is this many times as frequent.
FORM_FACTOR = 10
# A run with a hash divisible by this loses one letter.
DROP_EVERY = 31
UPPER = "".join(map(chr, range(0x41, 0x5B)))
LOWER = UPPER.lower()
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
# Pairs of words that a pair of buckets may expand to.
PAIR_LIMIT = 4096
# Fingerprints made at once.
CELLS = 1 << 20
SALT = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH_MIX = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------- words

def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters with A-Z in lower case, one letter
    deleted where the run's hash says so, of at least ``min_length`` letters
    and ``min_count`` occurrences."""
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    rows = (spread(docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`")))
            .select("id", F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run")))
    h = crc32_text(F.concat("id", F.lit(":"), "run"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).filter(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


# ----------------------------------------------------------- reduced words

def alphabet(symbols: int) -> str:
    """The symbol of every one of ``LETTERS``, by a hash of its code point;
    all letters stay themselves from their number on."""
    if symbols >= len(LETTERS):
        return LETTERS
    return "".join(LETTERS[(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) * symbols >> 32] for c in LETTERS)


def levels(n_words: int) -> list[int]:
    """Alphabet sizes: the first gives words of eight letters a bucket each
    on average, the last is all letters."""
    first = 4
    while first ** 8 < n_words and first < 32:
        first *= 2
    return [first, *[s for s in (16, 64) if s > first], len(LETTERS)]


def fingerprints(x: np.ndarray) -> np.ndarray:
    """Fingerprint of every row of symbols (all rows have one length)."""
    return (x * _powers(x.shape[1])[::-1]).sum(1, dtype=np.uint64) + _length_term(x.shape[1])


def _length_term(length: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.uint64(length) * LENGTH_MIX


def _powers(n: int) -> np.ndarray:
    """``BASE ** k`` for ``k < n``, modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), BASE)], dtype=np.uint64)[:n]


def neighbours(x: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, fingerprint)`` of the neighbours of every row of ``x``: all
    its deletions, and the replacements with a higher fingerprint."""
    length = x.shape[1]
    power = _powers(length)[::-1]
    weighted = x * power
    own = weighted.sum(1, dtype=np.uint64) + _length_term(length)
    if length > 1:
        # Without letter i: letters before it weigh one power less.
        less = np.r_[power[1:], np.uint64(0)]
        head = np.cumsum(x * less, 1, dtype=np.uint64)
        tail = np.cumsum(weighted[:, ::-1], 1, dtype=np.uint64)[:, ::-1]
        cut = np.zeros_like(x)
        cut[:, 1:] += head[:, :-1]
        cut[:, :-1] += tail[:, 1:]
        first = np.ones(x.shape, bool)  # of a run of equal letters: each deletion gives the same word
        first[:, 1:] = x[:, 1:] != x[:, :-1]
        row, at = np.nonzero(first)
        yield row, cut[row, at] + _length_term(length - 1)
    step = max(1, CELLS // max(1, x.shape[0] * len(symbols)))
    for lo in range(0, length, step):
        part = slice(lo, min(length, lo + step))
        key = own[:, None, None] + (symbols[None, None, :] - x[:, part, None]) * power[None, part, None]
        row, at, s = np.nonzero((key > own[:, None, None]) & (symbols[None, None, :] != x[:, part, None]))
        yield row, key[row, at, s]


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, matrix of code points)`` for the words of each length,
    in bounded pieces."""
    words = col.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        step = max(1, CELLS // (16 * max(1, length)))
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            text = "".join(words[k] for k in some).encode("utf-32-le")
            yield some, np.frombuffer(text, "<u4").reshape(len(some), length).astype(np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, bucket, n)`` of every reduced word."""
    for b in batches:
        key = np.zeros(b.num_rows, np.uint64)
        for at, x in _by_length(b.column(0)):
            key[at] = fingerprints(x)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1), b.column(2)], names=["key", "bucket", "n"])


def _neighbour_keys(letters: str):
    symbols = np.array(sorted(set(map(ord, letters))), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            for at, x in _by_length(b.column(0)):
                for row, key in neighbours(x, symbols):
                    of = at[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(bucket[of]), pa.array(n[of])], names=["key", "a", "n_a"])
    return run


# -------------------------------------------------------------- near words

def _bucket(letters: str) -> Column:
    return F.xxhash64(_reduced(letters))


def _reduced(letters: str) -> Column:
    return F.col("word") if letters == LETTERS else F.translate("word", LETTERS, letters)


def _links(words: DataFrame, letters: str) -> DataFrame:
    """Stored pairs of buckets ``(a, b, pairs)`` whose reduced words are
    equal (``a = b``) or one edit apart; ``pairs``: of words, at most."""
    reduced = stored(words.groupBy(_reduced(letters).alias("reduced")).agg(F.count(F.lit(1)).alias("n"))
                     .select("reduced", F.xxhash64("reduced").alias("bucket"), "n"), "reduced")
    own = reduced.mapInArrow(_keys, "key long, bucket long, n long")
    # Reduced words are spread anew: their table may be few files.
    near = (spread(reduced).mapInArrow(_neighbour_keys(letters), "key long, a long, n_a long")
            .join(own.select("key", F.col("bucket").alias("b"), F.col("n").alias("n_b")).hint("shuffle_hash"), "key")
            .select("a", "b", (F.col("n_a") * F.col("n_b")).alias("pairs")))
    same = (reduced.groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
            .select(F.col("bucket").alias("a"), F.col("bucket").alias("b"), (F.col("n") * F.col("n")).alias("pairs")))
    return stored(near.unionByName(same), "links")


def near_words(words: DataFrame, pair_limit: int = PAIR_LIMIT, sizes: list[int] | None = None) -> DataFrame:
    """Stored pairs ``(word, n, near, n_near)`` of words exactly one edit
    apart, each pair once.  ``words``: a stored table ``(word, n)``."""
    ship_package(words.sparkSession)
    found: DataFrame | None = None
    sizes = sizes or levels(words.count())
    for size in sizes:
        letters = alphabet(size)
        links = _links(words, letters)
        light = links if size == sizes[-1] else links.filter(F.col("pairs") <= pair_limit)
        keyed = words.select("word", "n", _bucket(letters).alias("bucket"))
        pairs = (light.join(keyed.select(F.col("bucket").alias("a"), "word", "n"), "a")
                 .join(keyed.select(F.col("bucket").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
                 .filter(((F.col("a") != F.col("b")) | (F.col("word") < F.col("near")))
                         & (F.levenshtein("word", "near", 1) == 1))
                 .select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near"),
                         F.when(F.col("word") < F.col("near"), F.col("n")).otherwise(F.col("near_n")).alias("n"),
                         F.when(F.col("word") < F.col("near"), F.col("near_n")).otherwise(F.col("n")).alias("near_n")))
        pairs = stored(pairs, "near")
        found = pairs if found is None else found.unionByName(pairs)
        if size == sizes[-1]:
            break
        heavy = links.filter(F.col("pairs") > pair_limit)
        if heavy.isEmpty():
            break
        buckets = heavy.select(F.explode(F.array("a", "b")).alias("bucket")).distinct()
        words = stored(keyed.join(buckets, "bucket", "left_semi").select("word", "n"), "again")
    return found.dropDuplicates(["word", "near"]).select("word", "n", "near", "near_n")


# ------------------------------------------------------------------- forms

def roots(forms: DataFrame) -> DataFrame:
    """``(word, form, root)`` of ``(word, form)``: forms followed to the
    last.  Every step multiplies the count, so chains are short.

    A frequent form may be that of many words; the forms that have a form
    themselves are few and meet their words by a broadcast behind a count,
    else by a join with salted copies."""
    cur = stored(forms.select("word", "form", F.col("form").alias("root")), "roots")
    while True:
        inner = stored(forms.join(cur.select(F.col("root").alias("word")).distinct(), "word", "left_semi")
                       .select(F.col("word").alias("root"), F.col("form").alias("next")), "inner")
        n = inner.count()
        if not n:
            return cur
        if n <= BROADCAST_ROW_LIMIT:
            step = cur.join(F.broadcast(inner), "root", "left")
        else:
            salted = inner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            step = (cur.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int"))
                    .join(salted, ["root", "salt"], "left"))
        cur = stored(step.select("word", "form", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, factor: int = FORM_FACTOR, id_col: str = "doc_id", text_col: str = "text",
                   pair_limit: int = PAIR_LIMIT, sizes: list[int] | None = None) -> DataFrame:
    """Every word with its near words' number, form and root:
    ``(word, form, root, n, n_near, form_n)``."""
    words = stored(word_counts(docs, id_col=id_col, text_col=text_col), "vocabulary")
    near = near_words(words, pair_limit, sizes)
    both = near.unionByName(near.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                        F.col("word").alias("near"), F.col("n").alias("near_n")))
    # Counts descend, then words ascend by code point (UTF-8 order).
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    per_word = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.n") >= factor * F.col("n")
    table = stored(words.join(per_word, "word", "left")
                   .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                           F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")),
                   "forms")
    last = roots(table.filter("form is not null").select("word", "form"))
    return (table.join(last.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


# DuckDB has no crc32: bytes are folded through the polynomial's table, and
# near words meet by deletions (its levenshtein counts bytes).
ORACLE = f"""
WITH RECURSIVE bit(i, k, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM bit WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
long AS (SELECT id, run, count(*) AS n, hex(id || ':' || run) AS x FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2),
hashed AS MATERIALIZED (SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8))) AS h FROM long, tab),
w0 AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n
  FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w0 WHERE length(word) >= {MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT word, i, length(word) AS size, word[1:i - 1] || word[i + 1:] AS v FROM w, generate_series(1, 64) g(i) WHERE i <= length(word)),
near AS MATERIALIZED (SELECT a.word, b.word AS near FROM d a JOIN d b USING (v, i, size) WHERE a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.v UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.v),
r AS (SELECT near.word, near, b.n AS near_n, row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, near) AS k,
  count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN w b ON b.word = near.near),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {FORM_FACTOR} * w.n THEN r.near END AS form,
  CASE WHEN r.near_n >= {FORM_FACTOR} * w.n THEN r.near_n END AS form_n FROM w LEFT JOIN r ON r.word = w.word AND r.k = 1),
walk(word, last, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = walk.last WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(last, k) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN root USING (word)"""
