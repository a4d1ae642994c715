"""Vocabulary tables and token encoding for the ``word`` and ``char``
tokenisers (the ``subword`` tokeniser lives in ``subword.py``).

A vocabulary is a DataFrame ``(id INT, piece STRING, score DOUBLE,
cnt BIGINT, cacheable BOOLEAN)``.  Ids 0, 1, 2 are the reserved unknown and
two control pieces; learned pieces start at 3, ranked by corpus count
descending then piece ascending.  By default it holds every token of the
corpus; joins broadcast it only behind its counted rows and bytes
(``broadcast_bound``) and shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import text as T
from gramloom.session import cut_lineage, maybe_broadcast
from gramloom.sources.lines import dense_index
from pyspark import StorageLevel

RESERVED = 3


def tokens_expr(line_col, tokenizer: str):
    if tokenizer == "word":
        return T.word_tokens(line_col)
    if tokenizer == "char":
        return T.char_tokens(line_col)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def piece_counts(lines: DataFrame, tokenizer: str = "word", line_col: str = "line") -> DataFrame:
    """``(piece, cnt)`` over all tokens of the lines (map-side combined)."""
    return (lines.select(F.explode(tokens_expr(F.col(line_col), tokenizer)).alias("piece"))
            .groupBy("piece").agg(F.count(F.lit(1)).alias("cnt")))


def top_n_by_count(counts: DataFrame, n: int, cnt_col: str = "cnt", key_col: str = "piece") -> DataFrame:
    """The ``n`` rows with the largest count (ties: key ascending).

    ``orderBy().limit(n)`` alone would merge up to n rows from *every*
    partition in one task.  Instead the count cut-off is found first from
    the histogram of count values (at most sqrt(2 * total) distinct values,
    so that running sum is small), and only rows at or above it (about n,
    plus ties at the cut-off) go through the final top-n."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)  # read twice below
    hist = counts.groupBy(cnt_col).agg(F.count(F.lit(1)).alias("_n"))
    cum = hist.withColumn("_above", F.sum("_n").over(
        Window.orderBy(F.col(cnt_col).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cutoff = cum.filter(F.col("_above") >= n).agg(F.max(cnt_col)).first()[0]
    cand = counts if cutoff is None else counts.filter(F.col(cnt_col) >= F.lit(cutoff))
    top = cut_lineage(cand.orderBy(F.col(cnt_col).desc(), F.col(key_col).asc()).limit(n))  # n rows
    counts.unpersist()
    return top


def reserved_rows(spark) -> DataFrame:
    rows = [(K.UNK_ID, K.UNK_PIECE)] + [(i + 1, p) for i, p in enumerate(K.CONTROL_PIECES)]
    return spark.createDataFrame(rows, "id int, piece string").select(
        "id", "piece", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("cnt"))


def rank_pieces(counts: DataFrame) -> DataFrame:
    """``(id, piece, score, cnt)``: ids from ``RESERVED`` on by count
    descending, then piece ascending, over a cluster-wide sort."""
    ranked = dense_index(counts.select("piece", "cnt"), [F.col("cnt").desc(), F.col("piece").asc()], "_at")
    total = ranked.agg(F.sum("cnt")).first()[0] or 1
    return ranked.select((F.col("_at") + RESERVED).cast("int").alias("id"), "piece",
                         F.log(F.col("cnt") / F.lit(total)).alias("score"), "cnt")


def build_vocab(lines: DataFrame, tokenizer: str = "word", vocab_size: int | None = None,
                line_col: str = "line") -> DataFrame:
    """C5 + B5: the vocabulary of all tokens, so that no token of the corpus
    is unknown; with ``vocab_size`` (a model of fixed size) its most frequent
    pieces only."""
    spark = lines.sparkSession
    counts = piece_counts(lines, tokenizer, line_col).filter(
        ~F.col("piece").isin(K.UNK_PIECE, *K.CONTROL_PIECES))
    if vocab_size is not None:
        counts = top_n_by_count(counts, max(vocab_size - RESERVED, 0))
    vocab = reserved_rows(spark).unionByName(rank_pieces(counts))
    return vocab.withColumn("cacheable", T.is_cacheable_piece(F.col("piece"), F.col("id")))


def learned_pieces(vocab: DataFrame) -> DataFrame:
    """Pieces that text can encode to (reserved rows excluded)."""
    return vocab.filter(F.col("id") >= RESERVED).select("piece", "id", "cacheable")


# The part of a vocabulary of any size that is broadcast: at most so many pieces of at most so many characters (ids
# descend in frequency).
HEAD_PIECES = 200_000
HEAD_PIECE_LENGTH = 64


def head_and_tail(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The learned pieces in two: a head of bounded rows and bytes, ready to
    broadcast, and the rest."""
    v = learned_pieces(vocab)
    in_head = (F.col("id") < RESERVED + HEAD_PIECES) & (F.length("piece") <= HEAD_PIECE_LENGTH)
    return F.broadcast(v.filter(in_head)), v.filter(~in_head)


# Stands for the first word of a row that the head does not hold; OPEN - k for the (k + 1)-th distinct one.
OPEN = -3
# Lines encoded at once: bounds a batch's lists.
ENCODE_SLICE = 512
# Tokens of a task that gets rare words' ids.
TASK_TOKENS = 2_000_000


def head_ids(vocab: DataFrame) -> tuple:
    """``(broadcast dict piece -> id of the head, whether there is a tail)``,
    found once per vocabulary."""
    key = (HEAD_PIECES, HEAD_PIECE_LENGTH)
    if getattr(vocab, "_head_ids", (None,))[0] != key:
        head, tail = head_and_tail(vocab)
        ids = {r["piece"]: r["id"] for r in head.select("piece", "id").collect()}  # at most HEAD_PIECES
        vocab._head_ids = (key, vocab.sparkSession.sparkContext.broadcast(ids), not tail.isEmpty())
    return vocab._head_ids[1:]


def words_for(tokenizer: str):
    """The tokeniser as a plain function of a stripped line.  ``str.split``
    knows the white space of ``T.WS_CHARS``; ``tokens`` takes a line that is
    an array of tokens already; ``prefix`` gives the last,
    possibly unfinished, word of every prefix of the line."""
    if tokenizer == "word":
        return str.split
    if tokenizer in ("char", "tokens"):
        return list
    if tokenizer != "prefix":
        raise ValueError(f"unknown tokenizer {tokenizer!r}")

    def lasts(line):
        out, start, spaced = [], 0, False
        for i, c in enumerate(line):
            if c.isspace():
                spaced = True
                out.append(out[-1])
            else:
                if spaced:
                    start, spaced = i, False
                out.append(line[start:i + 1])
        return out
    return lasts


def encode_lines(lines: DataFrame, vocab: DataFrame, keep: list[str], tokenizer: str = "word", line_col: str = "line",
                 literal: dict[str, int] | None = None) -> DataFrame:
    """C2 for a vocabulary of any size: ``(*keep, ids ARRAY<INT>)`` of
    stripped lines, unknown tokens 0; ``literal`` gives words an id of
    their own, whatever the vocabulary says.

    The head of the vocabulary (bounded) is broadcast and settles nearly all
    tokens where they lie.  A line's distinct other words, which are rare, are
    joined with the tail, and the ids found go back to their lines: shuffled
    are rare words once and ids once, never the corpus's words."""
    from gramloom.sources.store import stored
    head, has_tail = head_ids(vocab)
    # Text spelled like a reserved piece is unknown and may be frequent.
    fixed = {p: 0 for p in (K.UNK_PIECE, *K.CONTROL_PIECES)} | (literal or {})
    split, n_keep, first_open, step = words_for(tokenizer), len(keep), OPEN, ENCODE_SLICE
    source = lines.select(*keep, F.col(line_col).alias("_line"))

    def run(batches):
        import pyarrow as pa
        get = (head.value | fixed).get
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                flat, ends, rare, rare_ends = [], [0], [], [0]
                for line in b.column(n_keep).to_pylist():
                    if line:
                        words = split(line)
                        ids = list(map(get, words))
                        if None in ids:
                            if has_tail:
                                seen: dict = {}
                                ids = [first_open - seen.setdefault(w, len(seen)) if x is None else x
                                       for x, w in zip(ids, words)]
                                rare += seen
                            else:
                                ids = [x or 0 for x in ids]
                        flat += ids
                    ends.append(len(flat))
                    rare_ends.append(len(rare))
                columns = [*b.columns[:n_keep], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                names = [*b.schema.names[:n_keep], "ids"]
                if has_tail:
                    columns.append(pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(rare, pa.string())))
                    names.append("_rare")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n_keep]) + "`ids` array<int>"
    if not has_tail:
        return source.mapInArrow(run, schema)
    coded = stored(source.mapInArrow(run, schema + ", `_rare` array<string>")
                   .withColumn("_r", F.monotonically_increasing_id()), "coded", "zstd")
    _, tail = head_and_tail(vocab)
    found = (coded.select("_r", F.posexplode("_rare").alias("_k", "piece"))
             .join(tail.select("piece", "id"), "piece")
             .groupBy("_r").agg(F.collect_list(F.shiftleft(F.col("_k").cast("bigint"), 32) + F.col("id")).alias("_found")))
    # Tasks of a bounded number of tokens, so that the n-grams counted behind them fit in memory.
    tokens, n_lines = (x or 0 for x in coded.agg(F.sum(F.size("ids")), F.count(F.lit(1))).first())
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TASK_TOKENS))
    joined = (coded.select(*keep, "ids", "_r", F.size("_rare").alias("_n")).repartition(parts, "_r")
              .join(found.hint("shuffle_hash"), "_r", "left").select(*keep, "ids", "_n", "_found"))

    def settle(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            ids, n, found = (b.column(n_keep + k) for k in range(3))
            n = n.to_numpy()
            base = np.cumsum(n) - n
            rows = np.arange(b.num_rows)
            flat = np.array(ids.flatten(), np.int32)
            length = ids.value_lengths().to_numpy(zero_copy_only=False)
            at = np.array(found.flatten(), np.int64)
            of = np.repeat(rows, found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            words = np.zeros(n.sum(), np.int32)  # a word without a partner stays unknown
            words[base[of] + (at >> 32)] = at & 0xFFFFFFFF
            spots = np.flatnonzero(flat <= first_open)
            flat[spots] = words[base[np.repeat(rows, length)[spots]] + (first_open - flat[spots])]
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             names=[*b.schema.names[:n_keep], "ids"])

    out = joined.mapInArrow(settle, schema)
    out._tokens = tokens + n_lines  # n-grams with an end marker are as many, of any length
    return out


def join_pieces(rows: DataFrame, token_col: str, vocab: DataFrame, vocab_bound: int | None) -> DataFrame:
    """Add ``id`` and ``cacheable`` of each token (null: unknown).  Behind
    its bound the vocabulary is broadcast; else its head is, and only rows
    of other tokens are shuffled, whose words are rare."""
    if vocab_bound is not None:
        return rows.join(maybe_broadcast(learned_pieces(vocab).withColumnRenamed("piece", token_col), vocab_bound),
                         token_col, "left")
    head, tail = (v.withColumnRenamed("piece", token_col) for v in head_and_tail(vocab))
    tried = cut_lineage(rows.join(head, token_col, "left"))
    rest = tried.filter(F.col("id").isNull()).drop("id", "cacheable").join(tail, token_col, "left")
    return tried.filter(F.col("id").isNotNull()).unionByName(rest)


def encode_tokens(df: DataFrame, key_cols: list[str], tokens_col: str, vocab: DataFrame,
                  vocab_bound: int | None, out_col: str = "ids") -> DataFrame:
    """Map a token array to ids (unknown -> 0), keeping order, and add
    the per-token pieces and cacheable flags as ``<out>_tok`` (array of
    ``struct<id INT, piece STRING, cacheable BOOLEAN>``).  Rows stay rows: of
    their tokens only rare ones are moved (:func:`encode_lines`), whatever the
    size of the vocabulary.  Rows of one key share their tokens, in the order
    of their places; a row with a null key has none."""
    coded = encode_lines(df.withColumn("_t", F.col(tokens_col)), vocab, df.columns, "tokens", "_t").withColumnRenamed("ids", "_ids")
    toks = F.transform(F.arrays_zip(F.col(tokens_col).alias("t"), F.col("_ids").alias("i")), lambda x, k: F.struct(
        k.alias("_pos"), F.struct(
            x["i"].alias("id"), F.when(x["i"] == K.UNK_ID, F.lit(K.UNK_SURFACE)).otherwise(x["t"]).alias("piece"),
            ((x["i"] == K.UNK_ID) | T.is_cacheable_piece(x["t"])).alias("cacheable")).alias("_t")))
    coded = coded.withColumn("_l", toks).drop("_ids")
    coded = coded.withColumn("_l", F.array_sort(F.flatten(F.collect_list("_l").over(Window.partitionBy(*key_cols)))))
    whole = F.lit(True)
    for c in key_cols:
        whole = whole & F.col(c).isNotNull()
    tok = F.transform("_l", lambda x: x["_t"])
    none = F.array().cast("array<struct<id:int,piece:string,cacheable:boolean>>")
    return (coded.withColumn(f"{out_col}_tok", F.when(whole, tok).otherwise(none)).drop("_l")
            .withColumn(out_col, F.transform(f"{out_col}_tok", lambda x: x["id"])))


def decode_pieces(pieces, tokenizer: str = "word"):
    """C3 on an array of piece strings: a space between words, nothing
    between characters; subword pieces turn their boundary mark into a
    space and lose the leading one."""
    p = F.col(pieces) if isinstance(pieces, str) else pieces
    if tokenizer == "word":
        return F.array_join(p, " ")
    if tokenizer == "char":
        return F.array_join(p, "")
    joined = F.replace(F.array_join(p, ""), F.lit(K.SPACE_MARK), F.lit(" "))
    return F.regexp_replace(joined, "^ ", "")


def decode_expr(tok_col, tokenizer: str = "word"):
    """C3 for arrays of ``struct<id, piece, ...>``."""
    c = F.col(tok_col) if isinstance(tok_col, str) else tok_col
    return decode_pieces(F.transform(c, lambda x: x["piece"]), tokenizer)


def char_coverage(lines: DataFrame, coverage: float = 1.0, line_col: str = "line") -> DataFrame:
    """Characters by count with their cumulative share; a character is
    kept while the share of more frequent characters is below ``coverage``.
    The ranked table has one row per distinct character (bounded by the
    character set), so the running sum runs on a small input."""
    cc = piece_counts(lines, "char", line_col).withColumnRenamed("piece", "ch")
    w = Window.orderBy(F.col("cnt").desc(), F.col("ch").asc())
    ranked = (cc.withColumn("rank", F.row_number().over(w).cast("int"))
              .withColumn("cum", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("total", F.sum("cnt").over(Window.partitionBy())))
    return ranked.select(
        "ch", "cnt", "rank",
        (F.col("cum") / F.col("total")).alias("cum_share"),
        ((F.col("cum") - F.col("cnt")) / F.col("total") < F.lit(coverage)).alias("kept"))


def prefix_rows(lines: DataFrame, key_cols: list[str], line_col: str = "line") -> DataFrame:
    """C4: every prefix ``line[0:i]`` (i = 1..length) of each stripped line
    with the number of its words and the last, possibly unfinished, one; a
    blank line yields nothing.  The whole line is processed, and cut into
    words once: a prefix ends in one of them or in the space behind it."""
    s = lines.withColumn("_s", T.strip(line_col)).filter(F.length("_s") > 0)
    parts = F.regexp_extract_all("_s", F.lit(f"[^{T.WS_CLASS[1:]}+{T.WS_CLASS}*"), F.lit(0))
    # Where each part starts, and behind the last of them the length of the line.
    starts = F.aggregate("_parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    s = s.select(*key_cols, "_s", parts.alias("_parts")).withColumn("_from", starts)
    zipped = F.transform("_parts", lambda p, k: F.struct(p.alias("part"), F.get("_from", k).alias("start")))
    word = s.select(*key_cols, "_s", F.posexplode(zipped).alias("_j", "_w"))
    word = word.select(*key_cols, "_s", "_j", "_w.start", F.length("_w.part").alias("_n"), T.strip(F.col("_w.part")).alias("_word"))
    pre = word.select(*key_cols, "_s", "_j", "start", "_word", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    return pre.select(*key_cols, (F.col("start") + F.col("_i")).alias("plen"), F.expr("substring(_s, 1, start + _i)").alias("prefix"),
                      (F.col("_j") + 1).alias("n_tokens"), F.expr("substring(_word, 1, _i)").alias("last_token"))


def prefix_pieces(lines: DataFrame, key_cols: list[str], vocab: DataFrame, vocab_bound: int | None = None,
                  line_col: str = "line") -> DataFrame:
    """C4 with its tokens: ``(*key_cols, plen, pieces, ids)`` for every prefix
    of every stripped line, by words.  Until the ids of the last, possibly
    unfinished, words of its prefixes are known, a line stays one row; its
    prefixes are made from it at the very end, so nothing of their length is
    moved.  The vocabulary may have any size.  Rows with a null key have
    none, and lines of one key are taken together when ids are looked up."""
    s = lines.dropna(subset=key_cols).select(*key_cols, T.strip(line_col).alias("_s")).filter(F.length("_s") > 0)
    coded = encode_lines(s, vocab, [*key_cols, "_s"], "prefix", "_s").withColumn("_c", T.char_tokens("_s"))

    def space(k):
        return F.get("_c", k).rlike(f"^{T.WS_CLASS}$")
    starts = F.filter(F.sequence(F.lit(0), F.size("_c") - 1), lambda k: ~space(k) & F.coalesce(space(k - 1), F.lit(True)))
    rows = coded.select(*key_cols, "ids", T.word_tokens(F.col("_s")).alias("_w"), starts.alias("_starts"))
    # The prefixes of one word reach to the start of the next; the last of them ends in the whole word.
    rows = rows.withColumn("_next", F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("ids"))))
    rows = rows.withColumn("_words", F.transform("_next", lambda k: F.get("ids", k - 1)))
    # Lines that share a key share their words' ids, in the order of the words' places.
    placed = F.collect_list(F.transform("_words", lambda x, i: F.struct(i.alias("i"), x.alias("x")))).over(Window.partitionBy(*key_cols))
    rows = rows.withColumn("_words", F.transform(F.array_sort(F.flatten(placed)), lambda e: e["x"]))
    word = rows.select(*key_cols, "ids", "_w", "_words", "_next", F.posexplode(F.slice("_starts", 1, F.size("_starts"))).alias("_j", "_from"))
    pre = word.select(*key_cols, "ids", "_w", "_words", "_j", "_from",
                      F.explode(F.sequence(F.col("_from"), F.get("_next", "_j") - 1)).alias("_at"))
    return pre.select(
        *key_cols, (F.col("_at") + 1).alias("plen"),
        F.concat(F.slice("_w", 1, F.col("_j")), F.array(F.expr("substring(get(_w, _j), 1, _at - _from + 1)"))).alias("pieces"),
        F.concat(F.slice("_words", 1, F.col("_j")), F.array(F.get("ids", "_at"))).alias("ids"))


def bigram_to_ids(bigram: DataFrame, vocab: DataFrame, vocab_bound: int | None) -> DataFrame:
    """Re-key a string bigram model by id: ``<BOS>`` -> -1, ``<EOS>`` ->
    -2, other pieces via the vocabulary, unknown -> 0.  Several unknown
    strings that land on the same key are summed."""
    from gramloom.operators.counts import rows_to_ids

    def marked(name, i):
        sid = F.when(F.col(name) == K.BOS_PIECE, K.BOS_ID).when(F.col(name) == K.EOS_PIECE, K.EOS_ID).cast("int")
        return sid.alias(f"s{i}"), F.when(sid.isNull(), F.col(name)).alias(f"t{i}")

    rows = bigram.select("cnt", *marked("w1", 0), *marked("w2", 1))
    return (rows_to_ids(rows, vocab, 2, ["cnt"], vocab_bound)
            .groupBy("w1", "w2").agg(F.sum("cnt").alias("cnt")))
