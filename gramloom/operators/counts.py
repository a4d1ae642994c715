"""N-gram counting, partial models, merging, sharding, nested form,
corpus statistics.

Every count is one ``explode`` of in-row n-gram windows followed by one
``groupBy().count()``; Spark's partial (map-side) aggregation plays the role
of the per-chunk partial models, and the exchange on the n-gram key is the
shard-and-reduce step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import arrays as A
from gramloom.operators.vocab import (HEAD_PIECE_LENGTH, HEAD_PIECES, RESERVED, encode_lines, head_and_tail, learned_pieces,
                                     tokens_expr)
from gramloom.session import BROADCAST_ROW_LIMIT, cut_lineage, maybe_broadcast
from gramloom.sources import lines as L

# column names by position, for any n-gram length or context size in use
COLS = [f"w{i}" for i in range(1, 257)]


def bigram_counts(lines: DataFrame, tokenizer: str = "word", line_col: str = "line") -> DataFrame:
    """``(w1 STRING, w2 STRING, cnt BIGINT)`` over ``[<BOS>] ++ t ++ [<EOS>]``."""
    padded = lines.select(
        A.pad(tokens_expr(F.col(line_col), tokenizer), 1, K.BOS_PIECE, K.EOS_PIECE).alias("_p"))
    grams = padded.select(F.explode(A.ngram_structs("_p", 2, COLS[:2])).alias("g"))
    return grams.groupBy(F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2")).agg(
        F.count(F.lit(1)).alias("cnt"))


def _marked_tokens(tokens, n_bos: int, eos: bool, bos_id: int = K.BOS_ID, literal_sentinels: bool = False):
    """Pad a string-token array with sentinel markers carried beside the
    token: struct(s = sentinel id or null, t = token or null).  With
    ``literal_sentinels`` a word spelled like a sentinel piece takes the
    sentinel id, as in the string-keyed bigram model."""
    def mark(sid):
        return F.struct(F.lit(sid).cast("int").alias("s"), F.lit(None).cast("string").alias("t"))

    def literal(x):
        if not literal_sentinels:
            return F.lit(None).cast("int")
        return (F.when(x == K.BOS_PIECE, F.lit(K.BOS_ID)).when(x == K.EOS_PIECE, F.lit(K.EOS_ID))
                .otherwise(F.lit(None)).cast("int"))
    body = F.transform(tokens, lambda x: F.struct(literal(x).alias("s"), x.alias("t")))
    parts = [F.array_repeat(mark(bos_id), n_bos), body]
    if eos:
        parts.append(F.array(mark(K.EOS_ID)))
    return F.concat(*parts)


def gram_rows(lines: DataFrame, n: int, n_bos: int | None = None, eos: bool = True, tokenizer: str = "word",
              line_col: str = "line", extra_cols: list[str] | None = None, bos_id: int = K.BOS_ID,
              literal_sentinels: bool = False) -> DataFrame:
    """One row per n-gram occurrence: for every position ``i`` a sentinel id
    ``s<i>`` or a token ``t<i>``.  Windows are built inside each row."""
    n_bos = n - 1 if n_bos is None else n_bos
    extra_cols = extra_cols or []
    padded = lines.select(*extra_cols, _marked_tokens(
        tokens_expr(F.col(line_col), tokenizer), n_bos, eos, bos_id, literal_sentinels).alias("_p"))
    grams = padded.select(*extra_cols, F.explode(A.ngram_structs("_p", n, COLS[:n])).alias("g"))
    return grams.select(*extra_cols, *[F.col(f"g.{c}.s").alias(f"s{i}") for i, c in enumerate(COLS[:n])],
                        *[F.col(f"g.{c}.t").alias(f"t{i}") for i, c in enumerate(COLS[:n])])


def _with_ids(rows: DataFrame, vocab: DataFrame, n: int, keep: list[str], vocab_bound: int | None) -> DataFrame:
    """``w1..wn`` for rows of :func:`gram_rows`, by one join per position."""
    v = learned_pieces(vocab).select("piece", "id")
    for i in range(n):
        vi = maybe_broadcast(v.select(F.col("piece").alias(f"p{i}"), F.col("id").alias(f"i{i}")), vocab_bound)
        rows = rows.join(vi, F.col(f"t{i}") == F.col(f"p{i}"), "left")
    return rows.select(*keep, *[
        F.coalesce(F.col(f"s{i}"), F.col(f"i{i}"), F.lit(K.UNK_ID)).alias(COLS[i]) for i in range(n)])


def _split_by_head(rows: DataFrame, vocab: DataFrame, n: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ids for a vocabulary too large to broadcast: ``(settled, open)``.

    The head of the vocabulary (its most frequent pieces, bounded in rows
    and bytes) is broadcast and settles every row of common words where it
    lies.  Only rows with a
    word of the tail are shuffled, once per position.  Words of the head,
    sentinels and settled positions meet the tail under a salted key without
    a partner, and a word of the tail is rare, so no key is hot."""
    head, tail = head_and_tail(vocab)
    for i in range(n):
        rows = rows.join(head.select(F.col("piece").alias(f"p{i}"), F.col("id").alias(f"i{i}")),
                         F.col(f"t{i}") == F.col(f"p{i}"), "left")
    known = [F.coalesce(F.col(f"s{i}"), F.col(f"i{i}")) for i in range(n)]
    rows = cut_lineage(rows.select(*keep, *[k.alias(COLS[i]) for i, k in enumerate(known)],
                                   *[F.when(k.isNull(), F.col(f"t{i}")).alias(f"t{i}") for i, k in enumerate(known)]))
    is_open = F.coalesce(*[F.col(f"t{i}") for i in range(n)]).isNotNull()
    opened = rows.filter(is_open)
    # Tokens hold no white space, or are one character: a space and a number is none of them.
    salt = F.concat(F.lit(" -"), F.pmod(F.xxhash64(*COLS[:n], *[f"t{i}" for i in range(n)]), F.lit(1 << 16)).cast("string"))
    for i in range(n):
        opened = (opened.withColumn("_k", F.coalesce(F.col(f"t{i}"), salt))
                  .join(tail.select(F.col("piece").alias("_k"), F.col("id").alias("_id")), "_k", "left")
                  .withColumn(COLS[i], F.coalesce(COLS[i], "_id", F.lit(K.UNK_ID))).drop("_k", "_id"))
    cols = [*keep, *COLS[:n]]
    return rows.filter(~is_open).select(*cols), opened.select(*cols)


def rows_to_ids(rows: DataFrame, vocab: DataFrame, n: int, keep: list[str], vocab_bound: int | None) -> DataFrame:
    """``(*keep, w1..wn)`` for rows with a sentinel id ``s<i>`` or a token
    ``t<i>`` per position.  Behind its size bound the vocabulary is
    broadcast; else its head is, and only rows with rarer words are
    shuffled."""
    if vocab_bound is not None:
        return _with_ids(rows, vocab, n, keep, vocab_bound)
    settled, opened = _split_by_head(rows, vocab, n, keep)
    return settled.unionByName(opened)


def ids_ngram_rows(df: DataFrame, ids_col: str, n: int, n_bos: int | None = None, eos: bool = True,
                   keep: list[str] | None = None, bos_id: int = K.BOS_ID) -> DataFrame:
    """One row per n-gram occurrence of rows that carry token ids."""
    n_bos = n - 1 if n_bos is None else n_bos
    keep = keep or []
    padded = df.select(*keep, A.pad(F.col(ids_col), n_bos, bos_id, K.EOS_ID if eos else None).alias("_p"))
    grams = padded.select(*keep, F.explode(A.ngram_structs("_p", n, COLS[:n])).alias("g"))
    return grams.select(*keep, *[F.col(f"g.{c}").alias(c) for c in COLS[:n]])


def id_ngram_rows(lines: DataFrame, vocab: DataFrame, n: int, n_bos: int | None = None,
                  eos: bool = True, tokenizer: str = "word", vocab_bound: int | None = None,
                  line_col: str = "line", extra_cols: list[str] | None = None,
                  bos_id: int = K.BOS_ID, literal_sentinels: bool = False) -> DataFrame:
    """One row per n-gram occurrence with integer ids ``w1..wn``; unknown
    tokens become id 0.  With the rows of the vocabulary (``vocab_bound``, of
    any size) lines are encoded first (:func:`encode_lines`); without, the
    n-grams of strings get their ids (:func:`rows_to_ids`)."""
    keep = extra_cols or []
    if vocab_bound is not None:
        literal = {K.BOS_PIECE: K.BOS_ID, K.EOS_PIECE: K.EOS_ID} if literal_sentinels else None
        coded = encode_lines(lines, vocab, keep, tokenizer, line_col, literal)
        return ids_ngram_rows(coded, "ids", n, n_bos, eos, keep, bos_id)
    rows = gram_rows(lines, n, n_bos, eos, tokenizer, line_col, keep, bos_id, literal_sentinels)
    return rows_to_ids(rows, vocab, n, keep, vocab_bound)


# n-grams of a task that counts them.
TASK_GRAMS = 2_000_000


def dealt_grams(rows: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """``n`` n-grams (None: not known), one row each, dealt by ``keys`` to
    tasks of about ``TASK_GRAMS``, however few partitions the session shuffles
    to.  Nearly all long n-grams are rare, so combining them before the
    exchange saves little; behind it every grouping whose keys hold ``keys``
    lies in one task and moves nothing again."""
    if n is None:
        return rows
    parts = -(-n // TASK_GRAMS)
    few = parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(*keys) if few else rows.repartition(parts, *keys)


def id_ngram_counts(lines: DataFrame, vocab: DataFrame, n: int, n_bos: int | None = None, eos: bool = True,
                    tokenizer: str = "word", vocab_bound: int | None = None, line_col: str = "line",
                    by: list[str] | None = None, literal_sentinels: bool = False, contexts: DataFrame | None = None,
                    contexts_bound: int | None = None, deal: list[str] | None = None, salt_buckets: int | None = None) -> DataFrame:
    """``(*by, w1..wn, cnt)``: n-grams counted by id; ``deal`` names the
    columns by which they go to the tasks that count them (default: the ids).
    With ``salt_buckets`` they go by their context and the ``bucket`` of their
    follower, which is kept, so that nesting them (:func:`to_nested`) moves nothing.

    With the rows of the vocabulary (of any size) lines are encoded first, and
    one exchange of ids counts their n-grams.  Without, the *strings* are
    counted in that one exchange, and ids are joined to the
    distinct rows; of these, only rows with a word outside the vocabulary's
    head move again (they are summed once more, since unknown words share
    id 0).  ``contexts`` (the first ``n - 1`` ids) limits what is counted."""
    by = by or []
    ids = COLS[:n]
    asked = None
    if contexts is not None:
        asked = maybe_broadcast(contexts.select(*ids[:-1]).distinct(), contexts_bound)
    if vocab_bound is not None:
        literal = {K.BOS_PIECE: K.BOS_ID, K.EOS_PIECE: K.EOS_ID} if literal_sentinels else None
        coded = encode_lines(lines, vocab, by, tokenizer, line_col, literal)
        rows = ids_ngram_rows(coded, "ids", n, n_bos, eos, by)
        if asked is not None:  # before the aggregation, so other n-grams never reach the shuffle
            rows = rows.join(asked, ids[:-1], "left_semi")
        elif salt_buckets is not None:
            by = [*by, "bucket"]
            rows = dealt_grams(rows.withColumn("bucket", salt_of(ids[-1], salt_buckets)), [*ids[:-1], "bucket"], getattr(coded, "_tokens", None))
        else:
            rows = dealt_grams(rows, deal or ids, getattr(coded, "_tokens", None))
        return rows.groupBy(*by, *ids).agg(F.count(F.lit(1)).alias("cnt"))
    rows = gram_rows(lines, n, n_bos, eos, tokenizer, line_col, by, K.BOS_ID, literal_sentinels)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("cnt"))
    settled, opened = _split_by_head(counted, vocab, n, [*by, "cnt"])
    opened = opened.groupBy(*by, *ids).agg(F.sum("cnt").alias("cnt"))
    out = settled.select(*by, *ids, "cnt").unionByName(opened)
    return out if asked is None else out.join(asked, ids[:-1], "left_semi").select(*by, *ids, "cnt")


def ngram_counts(lines: DataFrame, vocab: DataFrame, n: int = 3, n_bos: int | None = None,
                 eos: bool = True, tokenizer: str = "word", vocab_bound: int | None = None,
                 line_col: str = "line", contexts: DataFrame | None = None,
                 contexts_bound: int | None = None) -> DataFrame:
    """D3: ``(w1..wn INT, cnt BIGINT)``; n=3 is D2.  With ``contexts`` (the
    first n-1 ids of the wanted n-grams) only those contexts are counted."""
    return id_ngram_counts(lines, vocab, n, n_bos, eos, tokenizer, vocab_bound, line_col,
                           contexts=contexts, contexts_bound=contexts_bound)


def trigram_counts(lines: DataFrame, vocab: DataFrame, tokenizer: str = "word",
                   vocab_bound: int | None = None, line_col: str = "line",
                   contexts: DataFrame | None = None, contexts_bound: int | None = None) -> DataFrame:
    """``(w1, w2, w3, cnt)`` over ``[-1,-1] ++ ids ++ [-2]``."""
    return ngram_counts(lines, vocab, 3, 2, True, tokenizer, vocab_bound, line_col, contexts, contexts_bound)


def ids_ngram_counts(df: DataFrame, ids_col: str, n: int = 3, n_bos: int | None = None,
                     eos: bool = True, total: int | None = None) -> DataFrame:
    """D3 over rows that already carry token ids (the subword tokeniser);
    ``total`` n-grams, if known, are counted in tasks of bounded size."""
    rows = dealt_grams(ids_ngram_rows(df, ids_col, n, n_bos, eos), COLS[:n], total)
    return rows.groupBy(*COLS[:n]).agg(F.count(F.lit(1)).alias("cnt"))


def partial_counts(docs: DataFrame, vocab: DataFrame, lines_per_chunk: int = K.DEFAULT_LINES_PER_CHUNK,
                   tokenizer: str = "word", vocab_bound: int | None = None,
                   text_col: str = "text", deal: list[str] | None = None) -> DataFrame:
    """Normalised non-blank lines numbered densely in source order are
    cut into chunks of ``lines_per_chunk``; counts per ``part_id``.

    The numbering is exact and distributed and reads the text once
    (``indexed_lines``); no window runs over all lines in one task.  By default
    a chunk's contexts lie in one task each; to merge chunks, ``deal`` by the
    ids, so that the merge moves nothing."""
    per_doc = L.valid_doc_lines(docs, normalize=True, text_col=text_col)
    lines = L.indexed_lines(per_doc).withColumn(
        "part_id", F.floor(F.col("idx") / F.lit(lines_per_chunk)).cast("int"))
    return id_ngram_counts(lines, vocab, 3, 2, True, tokenizer, vocab_bound, by=["part_id"], deal=deal or ["part_id", "w1"])


def partial_stats(parts: DataFrame) -> DataFrame:
    """D9 per chunk: ``(part_id, n_lines, n_samples, contexts, model_rows)``.
    Every line ends in one end marker and every n-gram occurrence is a
    sample, so the partial models hold all of it and no text is read again.
    (Metrics observed inside the counting job would count the tasks of a
    stage that runs again after a lost executor twice.)"""
    per_ctx = parts.groupBy("part_id", "w1", "w2").agg(
        F.sum(F.when(F.col("w3") == K.EOS_ID, F.col("cnt"))).alias("ends"),
        F.sum("cnt").alias("c"), F.count(F.lit(1)).alias("nf"))
    return per_ctx.groupBy("part_id").agg(
        F.sum("ends").alias("n_lines"), F.sum("c").alias("n_samples"),
        F.count(F.lit(1)).alias("contexts"), F.sum("nf").alias("model_rows"))


def bigram_id_counts(lines: DataFrame, vocab: DataFrame, tokenizer: str = "word",
                     vocab_bound: int | None = None, line_col: str = "line",
                     first_ids: DataFrame | None = None, first_bound: int | None = None) -> DataFrame:
    """D1 keyed by id, counted directly: ``(w1, w2, cnt)`` over ``[-1] ++ ids
    ++ [-2]`` with words spelled ``<BOS>``/``<EOS>`` taking the sentinel ids.
    Equal to counting strings and re-keying them (C6, collisions summed),
    but with one aggregation; with ``first_ids`` only those first ids are
    counted (filtered before the shuffle)."""
    return id_ngram_counts(lines, vocab, 2, 1, True, tokenizer, vocab_bound, line_col, literal_sentinels=True,
                           contexts=first_ids, contexts_bound=first_bound)


def merge_partials(parts: DataFrame) -> DataFrame:
    """Sum the partial models; independent of chunking and order."""
    return parts.groupBy("w1", "w2", "w3").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def with_shard(model: DataFrame, num_shards: int = K.DEFAULT_NUM_SHARDS) -> DataFrame:
    """Add ``shard`` = context hash mod ``num_shards``."""
    return model.withColumn("shard", A.shard_of(F.col("w1"), F.col("w2"), num_shards))


def shard_and_reduce(parts: DataFrame, num_shards: int = K.DEFAULT_NUM_SHARDS) -> DataFrame:
    """Bucket every partial context by its shard, reduce per shard.
    Grouping by ``(shard, w1, w2, w3)`` is one exchange; the shard is a
    function of the context, so a shard's rows end up together."""
    return (with_shard(parts, num_shards)
            .groupBy("shard", "w1", "w2", "w3").agg(F.sum("cnt").cast("bigint").alias("cnt")))


def shard_sizes(model: DataFrame, num_shards: int = K.DEFAULT_NUM_SHARDS) -> DataFrame:
    """Per shard: contexts, (context, follower) rows and total count."""
    s = with_shard(model, num_shards)
    per_ctx = s.groupBy("shard", "w1", "w2").agg(F.count(F.lit(1)).alias("nf"), F.sum("cnt").alias("c"))
    return per_ctx.groupBy("shard").agg(
        F.count(F.lit(1)).alias("contexts"),
        F.sum("nf").cast("bigint").alias("rows"),
        F.sum("c").cast("bigint").alias("total"))


# Rows of a context in the nested form, at most.
SALT_BUCKETS = 16


def salt_of(follower: str, salt_buckets: int) -> Column:
    return F.pmod(F.xxhash64(follower), F.lit(salt_buckets)).cast("int")


def to_nested(model: DataFrame, salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """D8 long -> nested: ``(w1, w2, bucket, followers MAP<INT,BIGINT>)``.

    A hot context (e.g. two start markers) may own a large share of all
    rows, so followers are salted into ``salt_buckets`` rows per context by
    a hash of the follower id; no single group holds a whole hot context.  A
    model that has its ``bucket`` lies by context and bucket already."""
    if "bucket" not in model.columns:
        model = model.withColumn("bucket", salt_of("w3", salt_buckets))
    return (model.groupBy("w1", "w2", "bucket")
            .agg(F.map_from_entries(F.collect_list(F.struct("w3", "cnt"))).alias("followers")))


def to_long(nested: DataFrame) -> DataFrame:
    """D8 nested -> long."""
    return nested.select("w1", "w2", F.explode("followers").alias("w3", "cnt"))


def corpus_stats(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """Total raw lines, valid normalised lines, contexts and rows of the
    model, total n-gram count.  One row."""
    per_doc = L.doc_lines(docs, text_col).select(
        F.size("lines").alias("n_raw"),
        F.size(F.filter(F.transform("lines", lambda x: L.T.normalize_line(x)),
                        lambda x: F.length(x) > 0)).alias("n_valid"))
    line_stats = per_doc.agg(F.sum("n_raw").cast("bigint").alias("total_lines"),
                             F.sum("n_valid").cast("bigint").alias("valid_lines"))
    ctx = model.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("nf"), F.sum("cnt").alias("c"))
    model_stats = ctx.agg(F.count(F.lit(1)).alias("contexts"),
                          F.sum("nf").cast("bigint").alias("model_rows"),
                          F.sum("c").cast("bigint").alias("total_count"))
    # both sides are single-row aggregates: a keyed join on a constant
    return (line_stats.withColumn("_k", F.lit(1))
            .join(model_stats.withColumn("_k", F.lit(1)), "_k").drop("_k"))


def with_pieces(model: DataFrame, vocab: DataFrame, vocab_bound: int | None) -> DataFrame:
    """Add ``piece`` and ``cacheable`` of ``w3``.  Behind its bound the
    vocabulary is broadcast; else its head is, and only rows that end in a
    rarer word are shuffled, so no follower is hot."""
    v = vocab.select(F.col("id").alias("w3"), "cacheable", "piece")
    if vocab_bound is not None:
        return model.join(maybe_broadcast(v, vocab_bound), "w3", "left")
    in_head = (F.col("w3") < RESERVED + HEAD_PIECES) & (F.length("piece") <= HEAD_PIECE_LENGTH)
    tried = model.join(F.broadcast(v.filter(in_head)), "w3", "left")
    # Sentinels are in no vocabulary; a frequent word of great length is split from its rows by AQE.
    is_open = F.col("piece").isNull() & (F.col("w3") >= 0)
    rest = tried.filter(is_open).drop("piece", "cacheable").join(v.filter(~in_head), "w3", "left")
    return tried.filter(~is_open).unionByName(rest)


def followers_table(model: DataFrame, vocab: DataFrame, k: int, key_cols: list[str],
                    vocab_bound: int | None = None) -> DataFrame:
    """Lookup form: one row per context with its followers as an array of
    ``struct<w3 INT, cnt BIGINT, cacheable BOOLEAN, piece STRING>`` sorted by
    ``cnt`` desc then ``w3`` asc.

    Kept: the top ``k`` followers among those a tree may pick (the end
    marker or cacheable tokens) and the top ``k`` of the others.  Their
    union contains the overall top ``k`` too, so plain sampling and tree
    ranking are both exact for any ``top_k <= k``.  ``row_number() <= k``
    plans as a window group limit, which also limits rows per key *before*
    the shuffle, so a hot context ships at most ``k`` rows per map task."""
    return followers_of(with_pieces(top_followers(model, vocab, k, key_cols), vocab, vocab_bound), key_cols)


def top_followers(model: DataFrame, vocab: DataFrame, k: int, key_cols: list[str], flag: str | None = None) -> DataFrame:
    """The rows :func:`followers_table` keeps, without their pieces: the few
    pieces of the vocabulary that a tree may not pick are known by their ids,
    so no string takes part in the exchange.  ``flag`` names a column for
    whether a follower is cacheable."""
    if not hasattr(vocab, "_barred"):
        barred = cut_lineage(vocab.filter(~F.col("cacheable")).select(F.col("id").alias("w3"), F.lit(True).alias("_bar")))
        vocab._barred = maybe_broadcast(barred, barred.count())
    m = model.join(vocab._barred, "w3", "left").withColumn(
        "_elig", (F.col("w3") == K.EOS_ID) | ((F.col("w3") >= 0) & F.col("_bar").isNull())).drop("_bar")
    if flag is not None:
        m = m.withColumn(flag, F.col("_elig") & (F.col("w3") != K.EOS_ID))
    w = Window.partitionBy(*key_cols, "_elig").orderBy(F.col("cnt").desc(), F.col("w3").asc())
    return m.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn", "_elig")


def followers_of(rows: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per context from model rows with ``piece`` and ``cacheable``."""
    m = (rows.withColumn("cacheable", F.coalesce("cacheable", F.lit(False)))
         .withColumn("piece", F.when(F.col("w3") == K.EOS_ID, F.lit(K.EOS_PIECE))
                     .when(F.col("w3") == K.UNK_ID, F.lit(K.UNK_SURFACE))
                     .otherwise(F.coalesce("piece", F.lit(K.UNK_SURFACE)))))
    return m.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("cnt")).alias("_neg"), F.col("w3"), F.col("cnt"), F.col("cacheable"), F.col("piece")
    ))).alias("_f")).select(*key_cols, F.transform("_f", lambda x: x.dropFields("_neg")).alias("followers"))


def asked_rows(model: DataFrame, asked: DataFrame, bound: int, key_cols: list[str]) -> DataFrame:
    """The rows of ``model`` whose context is asked.  A model in buckets of its
    contexts is streamed past them where it lies, however many are asked."""
    contexts = asked.select(*key_cols).distinct()
    small = bound <= BROADCAST_ROW_LIMIT
    return model.join(F.broadcast(contexts) if small else contexts.hint("shuffle_hash"), key_cols, "left_semi")


def asked_ids(model: DataFrame, asked: DataFrame, bound: int, vocab: DataFrame, k: int, key_cols: list[str]) -> DataFrame:
    """:func:`asked_followers` with null pieces: only ids are moved, and the
    pieces of the few followers that are picked come later
    (:func:`pieces_of`)."""
    return follower_ids(asked_rows(model, asked, bound, key_cols), vocab, k, key_cols)


def follower_ids(model: DataFrame, vocab: DataFrame, k: int, key_cols: list[str]) -> DataFrame:
    """:func:`followers_table` with null pieces, where ids are all that is
    wanted: no piece of the vocabulary is read or moved."""
    kept = top_followers(model, vocab, k, key_cols, flag="cacheable")
    return kept.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("cnt")).alias("_neg"), F.col("w3"), F.col("cnt"), F.col("cacheable"), F.lit(None).cast("string").alias("piece")
    ))).alias("_f")).select(*key_cols, F.transform("_f", lambda x: x.dropFields("_neg")).alias("followers"))


def pieces_of(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``_piece`` of the id ``w3``.  The vocabulary is
    read once past the distinct ids of the rows; behind their count these,
    and their pieces, are broadcast."""
    ids = cut_lineage(rows.select("w3").distinct())
    n = ids.count()
    found = vocab.select(F.col("id").alias("w3"), F.col("piece").alias("_piece")).join(maybe_broadcast(ids, n), "w3", "left_semi")
    out = rows.join(F.broadcast(found) if n <= HEAD_PIECES else found, "w3", "left")
    return out.withColumn("_piece", F.when(F.col("w3") == K.EOS_ID, F.lit(K.EOS_PIECE))
                          .when(F.col("w3") == K.UNK_ID, F.lit(K.UNK_SURFACE)).otherwise(F.coalesce("_piece", F.lit(K.UNK_SURFACE))))


def asked_followers(model: DataFrame, asked: DataFrame, bound: int, vocab: DataFrame, k: int,
                    key_cols: list[str]) -> DataFrame:
    """:func:`followers_table` for the asked contexts only (``bound``: their
    proven number).  The model is read where it lies; of it, only rows of asked
    contexts are shuffled, and the pieces of what is kept (at most ``2 * k``
    rows a context) come from one reading of the vocabulary."""
    kept = top_followers(asked_rows(model, asked, bound, key_cols), vocab, k, key_cols)
    spark = vocab.sparkSession
    ends = spark.createDataFrame([(K.EOS_ID, None, False), (K.BOS_ID, None, False)], "w3 int, piece string, cacheable boolean")
    pieces = vocab.select(F.col("id").alias("w3"), "piece", "cacheable").unionByName(ends)
    return followers_of(pieces.join(maybe_broadcast(kept, 2 * k * bound), "w3"), key_cols)
