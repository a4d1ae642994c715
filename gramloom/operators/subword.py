"""C1/C2/C3 for the ``subword`` tokeniser: a unigram language-model
vocabulary (Kudo 2018) learned with Spark.

* C1a: on request a reproducible sample of ``input_sentence_size`` lines
  (hash order, exact cut-off); by default all lines are used.
* Lines are compatibility-normalised (NFKC) and split on whitespace; each
  word becomes a chunk ``▁word``; pieces never cross chunks.  Distinct
  chunks with their counts are the training input (a ``groupBy``).
* Seeds: every character plus frequent substrings (up to
  ``max_piece_len``), exploded in the JVM and summed by ``groupBy``; the
  seed table is bounded by ``seed_size``.
* EM: the E-step runs forward-backward on many distinct chunks at once, as
  array arithmetic over the pieces found in them by a trie (a bounded,
  broadcast table), emitting expected piece counts; the M-step is ``groupBy(piece).sum`` and a
  normalisation.  Pruning drops the pieces whose removal costs the least
  likelihood (the best segmentation of the piece without itself is the
  alternative); single characters always stay.
* C2: Viterbi segmentation of whole texts where they lie, with a bounded
  memo of chunks; a run of unknown characters becomes one id 0.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gramloom import constants as K
from gramloom.functions import text as T
from gramloom.operators.vocab import top_n_by_count
from gramloom.session import cut_lineage, ship_package

RESERVED = 3
# expected count given to a required character that no segmentation uses
REQUIRED_FLOOR = 0.5
# expected counts travel as fixed-point integers (1/65536 units): their sums
# are exact and independent of the order in which partial sums arrive, so a
# rerun (or a recomputed task) learns the same vocabulary
FIXED_POINT = 1 << 16
CHUNK_SCHEMA = "chunk string, freq long"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    import unicodedata
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def sample_lines(lines: DataFrame, n: int, seed: int = K.NEURAL_SEED,
                 key_cols=("doc_id", "line_no")) -> DataFrame:
    """Exactly the ``min(n, total)`` lines of smallest hash (60 bits of
    md5 over seed and key; ties by key).

    The cut-off is found exactly from two histograms of the hash, by its top
    12 bits and by the next 12 inside the boundary bucket, so only the lines
    of one bucket in 16.7 million are sorted."""
    h = lines.withColumn("_h", F.conv(F.substring(F.md5(F.encode(F.concat_ws("-", F.lit(seed), *key_cols), "UTF-8")),
                                                  1, 15), 16, 10).cast("bigint"))
    need, floor, rows = n, 0, h
    for shift in (48, 36):
        counts = rows.groupBy(F.shiftright("_h", shift).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        before = 0  # at most 4096 buckets
        for r in sorted(counts, key=lambda r: r["b"]):
            if before + r["c"] > need:
                break
            before += r["c"]
        else:
            return (h if shift == 48 else h.filter(F.col("_h") < floor + (1 << 48))).drop("_h")
        need, floor = need - before, r["b"] << shift
        rows = h.filter((F.col("_h") >= floor) & (F.col("_h") < floor + (1 << shift)))
    below = h.filter(F.col("_h") < floor)
    return below.unionByName(rows.orderBy("_h", *key_cols).limit(need)).drop("_h")


def word_chunks(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Distinct ``▁word`` chunks of the NFKC-normalised lines with counts."""
    words = lines.select(F.explode(T.word_tokens(T.strip(nfkc(F.col(line_col))))).alias("w"))
    return words.groupBy(F.concat(F.lit(K.SPACE_MARK), F.col("w")).alias("chunk")).agg(
        F.count(F.lit(1)).alias("freq"))


def seed_pieces(chunks: DataFrame, seed_size: int, max_piece_len: int = 16) -> DataFrame:
    """Characters (all, coverage 1.0) + the top substrings by freq*length.
    A piece may hold the boundary mark only as its first character."""
    n = F.length("chunk")
    subs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max_piece_len), n - i + 1)),
        lambda ln: F.substring(F.col("chunk"), i, ln))))
    ex = chunks.select(F.explode(subs).alias("piece"), "freq")
    ex = ex.filter(~F.substring("piece", 2, max_piece_len).contains(K.SPACE_MARK))
    agg = ex.groupBy("piece").agg(F.sum("freq").alias("freq"))
    # Characters alone: taken from the rows below, all substrings would be made once more.
    chars = chunks.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("chunk"), i, F.lit(1))))
                          .alias("piece"), "freq").groupBy("piece").agg(F.sum("freq").alias("freq"))
    scored = agg.filter(F.length("piece") > 1).withColumn("_score", F.col("freq") * F.length("piece"))
    multi = top_n_by_count(scored, seed_size, "_score", "piece").drop("_score")
    pieces = chars.unionByName(multi)
    return pieces.select("piece", F.log(F.col("freq") / F.sum("freq").over(Window.partitionBy())).alias("logp"))


# ----------------------------------------------------------------- lattice helpers

def _logsumexp(a, b):
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def forward_backward(s: str, logp: dict, max_len: int):
    n = len(s)
    alpha = [-math.inf] * (n + 1)
    alpha[0] = 0.0
    for i in range(1, n + 1):
        acc = -math.inf
        for j in range(max(0, i - max_len), i):
            lp = logp.get(s[j:i])
            if lp is not None and alpha[j] != -math.inf:
                acc = _logsumexp(acc, alpha[j] + lp)
        alpha[i] = acc
    if alpha[n] == -math.inf:
        return None, {}
    beta = [-math.inf] * (n + 1)
    beta[n] = 0.0
    for j in range(n - 1, -1, -1):
        acc = -math.inf
        for i in range(j + 1, min(n, j + max_len) + 1):
            lp = logp.get(s[j:i])
            if lp is not None and beta[i] != -math.inf:
                acc = _logsumexp(acc, lp + beta[i])
        beta[j] = acc
    z = alpha[n]
    exp_counts: dict = {}
    for j in range(n):
        for i in range(j + 1, min(n, j + max_len) + 1):
            piece = s[j:i]
            lp = logp.get(piece)
            if lp is None:
                continue
            post = alpha[j] + lp + beta[i] - z
            exp_counts[piece] = exp_counts.get(piece, 0.0) + math.exp(post)
    return z, exp_counts


def viterbi(s: str, logp: dict, max_len: int, unk_logp: float = -1e9):
    """Best segmentation; a character without a piece is its own unknown
    piece (returned with ``None`` log-probability)."""
    n = len(s)
    best = [-math.inf] * (n + 1)
    back = [0] * (n + 1)
    best[0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(0, i - max_len), i):
            lp = logp.get(s[j:i])
            if lp is None and i - j == 1:
                lp = unk_logp
            if lp is not None and best[j] + lp > best[i]:
                best[i] = best[j] + lp
                back[i] = j
    out = []
    i = n
    while i > 0:
        j = back[i]
        out.append(s[j:i])
        i = j
    return out[::-1], best[n]


# Words of more characters than this go through the lattice one by one.
LONG_WORD = 200
# Characters of the words that go through it together.
LATTICE_CHARS = 200_000


def piece_trie(pieces: list[str], logp: list[float]) -> tuple:
    """The pieces as a trie in arrays: per level the sorted keys ``node << 21
    | character`` (the child of the key in place ``k`` of all is node ``k +
    1``), and the piece that ends in each node (-1: none)."""
    size = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first, node, levels, count, ends = np.cumsum(size) - size, np.zeros(len(pieces), np.int64), [], 1, [-1]
    for at in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > at)
        keys, place = np.unique(node[on] << 21 | flat[first[on] + at], return_inverse=True)
        node[on] = count + place
        levels.append((count, keys))
        count += len(keys)
        ends += [-1] * len(keys)
    ends = np.array(ends, np.int64)
    ends[node] = np.arange(len(pieces))
    return levels, ends, np.array(logp, np.float64)


def spans(words: list[str], trie: tuple, max_len: int) -> tuple:
    """All pieces in the words as arrays ``(word, start, length, piece)``, by
    word, start, length."""
    levels, ends, _ = trie
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    room = size[word] - start
    at, node, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
    for length, (base, keys) in enumerate(levels[:max_len], 1):
        on = room[at] >= length
        at, node = at[on], node[on]
        want = node << 21 | flat[at + length - 1]
        place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[place] == want
        at, node = at[hit], base + place[hit]
        piece = ends[node]
        whole = piece >= 0
        found.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
    at, length, piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 3))
    order = np.argsort(at * (max_len + 1) + length, kind="stable")
    at, length, piece = at[order], length[order], piece[order]
    return word[at], start[at], length, piece


def _groups(key):
    """Indices of equal keys, by ascending key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return np.split(order, cuts) if len(order) else []


def _add_logs(total, at, more):
    """``total[at] = logsumexp(total[at], more)``; no place comes twice."""
    old = total[at]
    top = np.maximum(old, more)
    with np.errstate(invalid="ignore"):
        total[at] = np.where(top == -np.inf, top, top + np.log(np.exp(old - top) + np.exp(more - top)))


def expected_counts(words: list[str], freqs, trie: tuple, max_len: int):
    """Expected counts of all pieces, summed over the words in fixed-point
    units: :func:`forward_backward` of many words at once, whose sums are
    taken in the same order."""
    word, start, length, piece = spans(words, trie, max_len)
    lp, size = trie[2][piece], np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size + 1) - size - 1
    lo, hi = first[word] + start, first[word] + start + length
    alpha, beta = np.full(len(words) + int(size.sum()), -np.inf), np.full(len(words) + int(size.sum()), -np.inf)
    alpha[first], beta[first + size] = 0.0, 0.0
    for g in _groups((start + length) * (max_len + 1) - length):  # by end, then start
        _add_logs(alpha, hi[g], alpha[lo[g]] + lp[g])
    for g in _groups(-start * (max_len + 1) + length):  # by start from the last, then end
        _add_logs(beta, lo[g], lp[g] + beta[hi[g]])
    z = alpha[first + size]
    ok = z[word] > -np.inf
    post = np.zeros(len(word))
    post[ok] = np.exp(alpha[lo[ok]] + lp[ok] + beta[hi[ok]] - z[word[ok]])
    # A piece's places in one word are added up before they are rounded.
    both, place = np.unique(word * len(trie[2]) + piece, return_inverse=True)
    units = np.rint(np.bincount(place, post, len(both)) * FIXED_POINT).astype(np.int64)
    out = np.zeros(len(trie[2]), np.int64)
    np.add.at(out, both % len(trie[2]), units * np.asarray(freqs, np.int64)[both // len(trie[2])])
    return out


def best_without_itself(pieces: list[str], trie: tuple, max_len: int, unk_logp: float = -1e9):
    """Per piece of the trie the log-probability of the best segmentation of
    its text by other pieces (:func:`viterbi` without the piece itself)."""
    word, start, length, piece = spans(pieces, trie, max_len)
    size = np.array([len(p) for p in pieces], np.int64)
    keep = length < size[word]
    word, start, length, lp = word[keep], start[keep], length[keep], trie[2][piece[keep]]
    first = np.cumsum(size + 1) - size - 1
    # Unknown characters, where no piece of one character lies.
    w = np.repeat(np.arange(len(pieces)), size)
    s = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    known = np.zeros(len(w) + len(pieces), bool)
    known[(first[word] + start)[length == 1]] = True
    miss = ~known[first[w] + s]
    word, start = np.concatenate([word, w[miss]]), np.concatenate([start, s[miss]])
    length, lp = np.concatenate([length, np.ones(miss.sum(), np.int64)]), np.concatenate([lp, np.full(miss.sum(), unk_logp)])
    lo, hi = first[word] + start, first[word] + start + length
    best = np.full(len(pieces) + int(size.sum()), -np.inf)
    best[first] = 0.0
    for g in _groups((start + length) * (max_len + 1) - length):
        best[hi[g]] = np.maximum(best[hi[g]], best[lo[g]] + lp[g])
    return best[first + size]


def _slices(words: list[str]):
    """Ranges of words of about ``LATTICE_CHARS`` characters."""
    at = np.cumsum([len(w) for w in words]) // LATTICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(words)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


# ----------------------------------------------------------------- training

def _e_step(chunks: DataFrame, pieces_pdf: pd.DataFrame, max_len: int) -> DataFrame:
    """Expected piece counts of one EM round, ``(piece, ecount_fx BIGINT)``
    per task, in fixed-point units."""
    spark = chunks.sparkSession
    pieces = list(pieces_pdf["piece"])
    bc = spark.sparkContext.broadcast((pieces, piece_trie(pieces, list(pieces_pdf["logp"]))))

    def run(batches):
        pieces, trie = bc.value
        acc = np.zeros(len(pieces), np.int64)
        row = None
        for pdf in batches:
            short = pdf["chunk"].str.len() <= LONG_WORD
            words, freqs = pdf["chunk"][short].tolist(), pdf["freq"][short].to_numpy()
            for a, b in _slices(words):
                acc += expected_counts(words[a:b], freqs[a:b], trie, max_len)
            for s, f in zip(pdf["chunk"][~short], pdf["freq"][~short]):
                if row is None:
                    row = {p: k for k, p in enumerate(pieces)}
                    logp = dict(zip(pieces, trie[2].tolist()))
                for p, c in forward_backward(s, logp, max_len)[1].items():
                    acc[row[p]] += int(round(c * FIXED_POINT)) * int(f)
        on = np.flatnonzero(acc)
        # As objects: a column of pandas' own strings may become an Arrow array in chunks.
        yield pd.DataFrame({"piece": pd.Series([pieces[k] for k in on], dtype=object), "ecount_fx": acc[on]})

    return chunks.mapInPandas(run, "piece string, ecount_fx long")


def _prune_losses(pieces_pdf: pd.DataFrame, counts: dict, max_len: int, spark) -> pd.DataFrame:
    """Per piece: expected count x (its log-prob - log-prob of the best
    segmentation of its text without it).  Computed in tasks over the piece
    table with the pieces broadcast."""
    bc = spark.sparkContext.broadcast(piece_trie(list(pieces_pdf["piece"]), list(pieces_pdf["logp"])))

    def run(batches):
        for pdf in batches:
            alt = np.full(len(pdf), -np.inf)
            words = pdf["piece"].tolist()
            for a, b in _slices(words):
                alt[a:b] = best_without_itself(words[a:b], bc.value, max_len)
            loss = np.where(pdf["piece"].str.len() == 1, np.inf, pdf["count"] * (pdf["logp"] - alt))
            yield pd.DataFrame({"piece": words, "logp": pdf["logp"], "loss": loss})

    rows = pieces_pdf.assign(count=[counts.get(p, 0.0) for p in pieces_pdf["piece"]])
    df = spark.createDataFrame(rows[["piece", "logp", "count"]], "piece string, logp double, count double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n).mapInPandas(run, "piece string, logp double, loss double").toPandas()


def train_unigram(lines: DataFrame, vocab_size: int = K.DEFAULT_VOCAB_SIZE,
                  input_sentence_size: int | None = None, seed: int = K.NEURAL_SEED,
                  seed_factor: int = 10, max_piece_len: int = 16, em_iters: int = 2,
                  shrink: float = 0.75, line_col: str = "line") -> DataFrame:
    """``(id, piece, score)`` with ids 0-2 reserved; at most
    ``vocab_size`` rows (fewer when the corpus has fewer candidate pieces).
    Raises ``ValueError`` if the characters alone don't fit."""
    spark = lines.sparkSession
    ship_package(spark)
    sample = lines if input_sentence_size is None else sample_lines(lines, input_sentence_size, seed)
    # Dealt evenly over all tasks: every round below reads them.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = cut_lineage(word_chunks(sample, line_col).repartition(parts))
    target = max(vocab_size - RESERVED, 1)
    pieces = seed_pieces(chunks, seed_factor * target, max_piece_len).toPandas()  # bounded by seed size
    # character coverage 1.0: every character of the sample stays a piece,
    # even when longer pieces absorb all of its probability mass
    required = [p for p in pieces["piece"] if len(p) == 1]
    if len(required) > target:
        raise ValueError(f"vocab_size {vocab_size} is too small: {len(required)} characters and {RESERVED} reserved pieces")
    while True:
        for _ in range(em_iters):
            counts_df = _e_step(chunks, pieces, max_piece_len).groupBy("piece").agg(
                F.sum("ecount_fx").alias("ecount_fx"))
            fx = dict((r.piece, int(r.ecount_fx)) for r in counts_df.toLocalIterator())
            floor = int(REQUIRED_FLOOR * FIXED_POINT)
            for ch in required:
                fx[ch] = max(fx.get(ch, 0), floor)
            total = sum(fx.values())
            counts = {p: v / FIXED_POINT for p, v in fx.items()}
            order = sorted(fx)
            pieces = pd.DataFrame({"piece": order,
                                   "logp": [math.log(fx[p]) - math.log(total) for p in order]})
        if len(pieces) <= target:
            break
        losses = _prune_losses(pieces, counts, max_piece_len, spark)
        keep_n = max(target, int(len(pieces) * shrink))
        n_chars = int((losses["piece"].str.len() == 1).sum())
        keep_n = max(keep_n, n_chars)
        kept = losses.sort_values(["loss", "piece"], ascending=[False, True]).head(keep_n)
        pieces = kept[["piece", "logp"]].reset_index(drop=True)
        if keep_n == target or len(pieces) <= target:
            break
    learned = spark.createDataFrame(pieces, "piece string, logp double")
    ranked = learned.select(
        (F.row_number().over(Window.orderBy(F.col("logp").desc(), F.col("piece").asc())) + (RESERVED - 1))
        .cast("int").alias("id"), "piece", F.col("logp").alias("score"))
    reserved = spark.createDataFrame(
        [(K.UNK_ID, K.UNK_PIECE, 0.0)] + [(i + 1, p, 0.0) for i, p in enumerate(K.CONTROL_PIECES)],
        "id int, piece string, score double")
    vocab = reserved.unionByName(ranked)
    return vocab.withColumn("cacheable", T.is_cacheable_piece(F.col("piece"), F.col("id")))


# ----------------------------------------------------------------- C2 C3

# Segmentations a task remembers, and the longest word among them.
MEMO_CHUNKS = 200_000
MEMO_LENGTH = 64
# Texts encoded at once: bounds a batch's lists.
ENCODE_SLICE = 256


class Segmenter:
    """Best segmentation of ``▁word`` chunks as row numbers of the piece
    table; number 0 is the unknown piece, one for a run of unknown
    characters.  Frequent words come from a bounded memo."""

    def __init__(self, pieces: list[str], scores: list[float], max_len: int):
        self.logp = dict(zip(pieces, scores))
        self.row = {p: k + 1 for k, p in enumerate(pieces)}
        self.heads = {p[:k] for p in pieces for k in range(1, min(len(p), max_len) + 1)}
        self.max_len = max_len
        self.memo: dict[str, list[int]] = {}

    def best(self, s: str, unk_logp: float = -1e9) -> list[str]:
        """:func:`viterbi`, from each place as far as some piece begins so."""
        n, logp, heads = len(s), self.logp, self.heads
        best, back = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for j in range(n):
            at = best[j]
            for i in range(j + 1, min(n, j + self.max_len) + 1):
                piece = s[j:i]
                lp = logp.get(piece)
                if lp is None and i - j == 1:
                    lp = unk_logp
                if lp is not None and at + lp > best[i]:
                    best[i], back[i] = at + lp, j
                if piece not in heads:
                    break
        out, i = [], n
        while i > 0:
            out.append(s[back[i]:i])
            i = back[i]
        return out[::-1]

    def __call__(self, chunk: str) -> list[int]:
        seg = self.memo.get(chunk)
        if seg is None:
            seg = []
            for p in self.best(chunk):
                k = self.row.get(p, 0)
                if k or not seg or seg[-1]:
                    seg.append(k)
            if len(chunk) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_CHUNKS:
                    self.memo.clear()
                self.memo[chunk] = seg
        return seg

    def of(self, words: list[str]):
        """The segmentations of a text's words, one after another."""
        chunks = [K.SPACE_MARK + w for w in words]
        segs = list(map(self.memo.get, chunks))
        if None in segs:
            segs = [self(c) if seg is None else seg for c, seg in zip(chunks, segs)]
        return chain.from_iterable(segs)


def encode_subword(df: DataFrame, key_cols: list[str], text_col: str, vocab: DataFrame,
                   max_piece_len: int = 16, out_col: str = "ids", ids_only: bool = False) -> DataFrame:
    """``<out>_tok`` (array of struct<id, piece, cacheable>) and ``<out>``
    (ids) per row, beside ``key_cols`` and the text; with ``ids_only`` the ids
    beside ``key_cols``, so that no strings come back.

    Texts are encoded whole where they lie, without a shuffle: the piece
    table (bounded by the vocabulary size) is broadcast, and a task keeps a
    bounded memo of the words it has met.  A null text has no pieces."""
    spark = df.sparkSession
    ship_package(spark)
    rows = vocab.filter(F.col("id") >= RESERVED).select("piece", "score", "id", "cacheable").collect()
    bc = spark.sparkContext.broadcast([tuple(r) for r in rows])  # at most the vocabulary size
    keys = df.select(*key_cols, F.col(text_col).alias("_text"))

    def run(batches):
        import unicodedata

        import pyarrow as pa

        def whole_array(x):  # take may give its result in chunks
            return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        table = bc.value
        segment = Segmenter([r[0] for r in table], [r[1] for r in table], max_piece_len)
        piece = pa.array([K.UNK_SURFACE, *(r[0] for r in table)], pa.string())
        ident = pa.array([K.UNK_ID, *(r[2] for r in table)], pa.int32())
        cacheable = pa.array([True, *(bool(r[3]) for r in table)], pa.bool_())
        for whole in batches:
            for lo in range(0, whole.num_rows, ENCODE_SLICE):
                b = whole.slice(lo, ENCODE_SLICE)
                flat, ends = [], [0]
                for text in b.column(len(key_cols)).to_pylist():
                    if text is not None:
                        if not text.isascii():
                            text = unicodedata.normalize("NFKC", text)
                        flat += segment.of(text.split())  # knows the white space of T.WS_CHARS
                    ends.append(len(flat))
                at, ends = pa.array(flat, pa.int32()), pa.array(ends, pa.int32())
                if ids_only:
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, whole_array(ident.take(at)))],
                                                     names=[*b.schema.names[:-1], out_col])
                    continue
                ids, pieces, flags = map(whole_array, (ident.take(at), piece.take(at), cacheable.take(at)))
                toks = pa.StructArray.from_arrays([ids, pieces, flags], ["id", "piece", "cacheable"])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.ListArray.from_arrays(ends, toks), pa.ListArray.from_arrays(ends, ids)],
                    names=[*b.schema.names, f"{out_col}_tok", out_col])

    if ids_only:
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys.schema.fields[:-1])
        return keys.mapInArrow(run, f"{schema}`{out_col}` array<int>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    out = keys.mapInArrow(run, f"{schema}, `{out_col}_tok` array<struct<id:int,piece:string,cacheable:boolean>>, "
                               f"`{out_col}` array<int>")
    return out.withColumnRenamed("_text", text_col)
