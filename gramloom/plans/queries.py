"""Registered queries over the test tables and their DuckDB oracles.

Every query reads whole tables (``documents``, ``conversations``, ``pages``,
``benchmark``) and returns scalar columns whose names match its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import text as T
from gramloom.operators import counts as C
from gramloom.operators import lookup as LK
from gramloom.operators import score as SC
from gramloom.operators import vocab as VO
from gramloom.plans import prompts as PR
from gramloom.plans.prompts import PROMPT_TURNS
from gramloom.plans import sqlparts as S
from gramloom.sources import lines as L
from gramloom.sources.store import stored
from gramloom.session import broadcast_bound, cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------- shared

def docs(spark, sf):
    return L.spread(L.read_table(spark, sf, "documents").select("doc_id", "text"))


def vocab(spark, sf):
    """The vocabulary of all words, built once and checkpointed so every
    lookup against it reuses the stored rows."""
    return stored(VO.build_vocab(L.corpus_lines(spark, sf, normalize=False)), "vocab", "zstd")


def counted(v):
    """Rows of the stored vocabulary, counted once."""
    if not hasattr(v, "_rows"):
        v._rows = v.count()
    return v._rows


def bound(v):
    """Counted bound for broadcasting the stored vocabulary, counted once."""
    if not hasattr(v, "_broadcast_bound"):
        v._broadcast_bound = (broadcast_bound(v, "piece"),)
    return v._broadcast_bound[0]


def trigram(spark, sf, vocab_df=None, contexts=None):
    """The trigram model; with ``contexts`` only the asked contexts are
    counted (their number is bounded by the prompts, counted first)."""
    v = vocab_df if vocab_df is not None else vocab(spark, sf)
    asked = contexts.count() if contexts is not None else None
    return C.trigram_counts(L.corpus_lines(spark, sf, normalize=True), v, vocab_bound=counted(v),
                            contexts=contexts, contexts_bound=asked)


# ------------------------------------------------------------------ A1 B1-B3

@register("lines_normalized", f"""
WITH {S.CLEAN_LINES}
SELECT doc_id, line_no, line FROM norm_lines""")
def q_lines_normalized(spark, sf):
    return L.clean_lines(L.read_lines(docs(spark, sf)), normalize=True)


# ----------------------------------------------------------------- C5 B5

CJK_MARKED = f"translate(text, '.,()[]', '{K.NORMALIZE_DELETE}')"


@register("lines_normalized_marks", f"""
WITH d AS (SELECT doc_id, regexp_split_to_array({CJK_MARKED}, '{S.NL}') AS parts FROM documents),
l AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM d)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {S.normalize('parts[i]')} AS line FROM l
WHERE length({S.normalize('parts[i]')}) > 0""")
def q_lines_normalized_marks(spark, sf):
    """B3 on the corpus with its stops, commas and brackets as the marks that
    normalising deletes (the texts themselves hold none)."""
    marked = docs(spark, sf).withColumn("text", F.expr(CJK_MARKED))
    return L.clean_lines(L.read_lines(marked), normalize=True)


@register("vocab_ids", f"""
WITH {S.VOCAB}
SELECT id, piece, round(score, 6) AS score, cnt, cacheable FROM vocab""")
def q_vocab_ids(spark, sf):
    return vocab(spark, sf).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ D1 D2 D3

@register("bigram_counts", f"""
WITH {S.CLEAN_LINES},
padded AS (SELECT list_concat(['{K.BOS_PIECE}'], {S.words('line')}, ['{K.EOS_PIECE}']) AS p FROM clean_lines),
pidx AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM padded)
SELECT p[i] AS w1, p[i + 1] AS w2, count(*)::BIGINT AS cnt FROM pidx GROUP BY 1, 2""")
def q_bigram_counts(spark, sf):
    return C.bigram_counts(L.corpus_lines(spark, sf, normalize=False))


@register("trigram_counts", f"""
WITH {S.VOCAB}, {S.ngram_ids(3, 2, True, 'norm_lines')}
SELECT w1, w2, w3, count(*)::BIGINT AS cnt FROM g GROUP BY 1, 2, 3""")
def q_trigram_counts(spark, sf):
    return trigram(spark, sf)


@register("ngram4_counts", f"""
WITH {S.VOCAB}, {S.ngram_ids(4, 3, True, 'norm_lines')}
SELECT w1, w2, w3, w4, count(*)::BIGINT AS cnt FROM g GROUP BY 1, 2, 3, 4""")
def q_ngram4_counts(spark, sf):
    v = vocab(spark, sf)
    return C.ngram_counts(L.corpus_lines(spark, sf, normalize=True), v, n=4, vocab_bound=counted(v))


# ------------------------------------------------------------- B8 B12

def requests(spark, sf):
    return PR.conversation_requests(L.read_table(spark, sf, "conversations"))


REQ_COLS = "prompt_id, prompt, max_tokens, top_k, temperature, min_len_before_eos, cache_alpha, cache_recent_window"


@register("prompt_requests", f"""
WITH req AS (SELECT (conv_id::BIGINT * {PROMPT_TURNS} + turn)::BIGINT AS prompt_id, text AS prompt FROM conversations WHERE role = 'user')
SELECT prompt_id, prompt, {K.GEN_MAX_TOKENS} AS max_tokens, {K.GEN_TOP_K} AS top_k,
       {K.GEN_TEMPERATURE}::DOUBLE AS temperature, {K.GEN_MIN_LEN_BEFORE_EOS} AS min_len_before_eos,
       {K.CACHE_ALPHA}::DOUBLE AS cache_alpha, {K.CACHE_RECENT_WINDOW} AS cache_recent_window
FROM req WHERE prompt IS NOT NULL AND length({S.strip('prompt')}) > 0""")
def q_prompt_requests(spark, sf):
    return PR.split_requests(requests(spark, sf))[0]


@register("prompt_rejects", f"""
WITH req AS (SELECT (conv_id::BIGINT * {PROMPT_TURNS} + turn)::BIGINT AS prompt_id, text AS prompt FROM conversations WHERE role = 'user')
SELECT prompt_id, prompt, '{K.REJECT_REASON_PROMPT}' AS reason
FROM req WHERE prompt IS NULL OR length({S.strip('prompt')}) = 0""")
def q_prompt_rejects(spark, sf):
    return PR.split_requests(requests(spark, sf))[1]


LINE_REQUESTS_SQL = f"""
WITH {S.RAW_LINES},
req AS (SELECT doc_id::BIGINT * {PROMPT_TURNS} + line_no AS prompt_id, line AS prompt,
               CASE line_no % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 WHEN 3 THEN 1.25 END::DOUBLE AS temperature,
               CASE WHEN line_no % 3 > 0 THEN 10 * (line_no % 3) END::INTEGER AS top_k,
               CASE WHEN line_no % 5 > 0 THEN line_no % 5 END::INTEGER AS max_tokens FROM raw_lines)"""


def line_requests(spark, sf):
    """Every raw line of the corpus, blank ones included, as a request; some
    settings are set by the line number and some are left out."""
    n = F.col("line_no")
    return L.read_lines(docs(spark, sf)).select(
        (F.col("doc_id").cast("bigint") * PROMPT_TURNS + n).alias("prompt_id"), F.col("line").alias("prompt"),
        F.when(n % 4 == 1, 0.5).when(n % 4 == 2, 0.0).when(n % 4 == 3, 1.25).alias("temperature"),
        F.when(n % 3 > 0, 10 * (n % 3)).alias("top_k"), F.when(n % 5 > 0, n % 5).alias("max_tokens"))


@register("line_requests", f"""{LINE_REQUESTS_SQL}
SELECT prompt_id, prompt, coalesce(max_tokens, {K.GEN_MAX_TOKENS}) AS max_tokens, coalesce(top_k, {K.GEN_TOP_K}) AS top_k,
       coalesce(temperature, {K.GEN_TEMPERATURE}) AS temperature, {K.GEN_MIN_LEN_BEFORE_EOS} AS min_len_before_eos,
       {K.CACHE_ALPHA}::DOUBLE AS cache_alpha, {K.CACHE_RECENT_WINDOW} AS cache_recent_window
FROM req WHERE length({S.strip('prompt')}) > 0 AND (temperature IS NULL OR temperature > 0)""")
def q_line_requests(spark, sf):
    return PR.split_requests(line_requests(spark, sf))[0].select(*REQ_COLS.split(", "))


@register("line_rejects", f"""{LINE_REQUESTS_SQL}
SELECT prompt_id, prompt, CASE WHEN length({S.strip('prompt')}) = 0 THEN '{K.REJECT_REASON_PROMPT}'
       ELSE 'temperature must be positive' END AS reason
FROM req WHERE length({S.strip('prompt')}) = 0 OR temperature <= 0""")
def q_line_rejects(spark, sf):
    return PR.split_requests(line_requests(spark, sf))[1]


# ------------------------------------------------------------- C2 C4

@register("tokens_word", f"""
WITH {S.VOCAB},
t0 AS (SELECT conv_id, turn, {S.words(S.strip('text'))} AS ws FROM conversations),
t1 AS (SELECT conv_id, turn, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM t0)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token, coalesce(v.id, 0) AS id
FROM t1 LEFT JOIN (SELECT piece, id FROM vocab WHERE id >= 3) v ON v.piece = t1.token""")
def q_tokens_word(spark, sf):
    conv = L.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    toks = conv.select("conv_id", "turn", F.posexplode(T.word_tokens(T.strip("text"))).alias("pos", "token"))
    v = vocab(spark, sf)
    return (VO.join_pieces(toks, "token", v, bound(v))
            .select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "token",
                    F.coalesce("id", F.lit(K.UNK_ID)).alias("id")))


@register("tokens_char", f"""
WITH t0 AS (SELECT conv_id, turn, regexp_extract_all({S.strip('text')}, '(?s).', 0) AS cs FROM conversations),
t1 AS (SELECT conv_id, turn, unnest(cs) AS ch, generate_subscripts(cs, 1) - 1 AS pos FROM t0)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, ch FROM t1""")
def q_tokens_char(spark, sf):
    conv = L.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return conv.select("conv_id", "turn", F.posexplode(T.char_tokens(T.strip("text"))).alias("pos", "ch")) \
        .select("conv_id", "turn", F.col("pos").cast("int").alias("pos"), "ch")


@register("prefix_tokens", f"""
WITH l0 AS (SELECT conv_id, turn, regexp_split_to_array(text, '{S.NL}') AS parts FROM conversations),
l1 AS (SELECT conv_id, turn, parts, unnest(generate_series(1, len(parts))) AS i FROM l0),
l2 AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, {S.strip('parts[i]')} AS s FROM l1),
p0 AS (SELECT conv_id, turn, line_no, s, unnest(generate_series(1, length(s))) AS plen FROM l2 WHERE length(s) > 0),
p1 AS (SELECT conv_id, turn, line_no, CAST(plen AS INTEGER) AS plen, substring(s, 1, plen) AS prefix FROM p0)
SELECT conv_id, turn, line_no, plen, CAST(len({S.words(S.strip('prefix'))}) AS INTEGER) AS n_tokens,
       {S.words(S.strip('prefix'))}[-1] AS last_token FROM p1""")
def q_prefix_tokens(spark, sf):
    conv = L.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    lines = conv.select("conv_id", "turn", F.posexplode(T.split_lines("text")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("int"))
    pre = VO.prefix_rows(lines, ["conv_id", "turn", "line_no"])
    return pre.select("conv_id", "turn", "line_no", "plen", "n_tokens", "last_token")


@register("prefix_pieces", f"""
WITH {S.VOCAB},
l0 AS (SELECT conv_id, turn, regexp_split_to_array(text, '{S.NL}') AS parts FROM conversations),
l1 AS (SELECT conv_id, turn, parts, unnest(generate_series(1, len(parts))) AS i FROM l0),
l2 AS (SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line_no, {S.strip('parts[i]')} AS s FROM l1),
p0 AS (SELECT conv_id, turn, line_no, s, unnest(generate_series(1, length(s))) AS plen FROM l2 WHERE length(s) > 0),
p1 AS (SELECT conv_id, turn, line_no, CAST(plen AS INTEGER) AS plen, {S.words(S.strip('substring(s, 1, plen)'))} AS ws FROM p0),
p2 AS (SELECT conv_id, turn, line_no, plen, unnest(ws) AS piece, generate_subscripts(ws, 1) AS pos FROM p1)
SELECT conv_id, turn, line_no, plen, string_agg(piece, ' ' ORDER BY pos) AS pieces,
       string_agg(coalesce(v.id, 0)::VARCHAR, ',' ORDER BY pos) AS ids
FROM p2 LEFT JOIN (SELECT piece, id FROM vocab WHERE id >= 3) v USING (piece) GROUP BY 1, 2, 3, 4""")
def q_prefix_pieces(spark, sf):
    conv = L.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    lines = L.spread(conv).select("conv_id", "turn", F.posexplode(T.split_lines("text")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no").cast("int"))
    v = vocab(spark, sf)
    out = VO.prefix_pieces(lines, ["conv_id", "turn", "line_no"], v, bound(v))
    return out.select("conv_id", "turn", "line_no", "plen", F.array_join("pieces", " ").alias("pieces"),
                      F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# ------------------------------------------------------------- E1-E6

TOP_K = K.GEN_TOP_K


def prompt_contexts(spark, sf, v):
    acc, _ = PR.split_requests(requests(spark, sf))
    return LK.encode_prompts(acc, v, bound(v))


def bigram_ids(spark, sf, v, first_ids=None):
    """Id-keyed bigram model for lookups (counted directly by id); with
    ``first_ids`` only the asked previous tokens are counted."""
    asked = first_ids.count() if first_ids is not None else None
    return C.bigram_id_counts(L.corpus_lines(spark, sf, normalize=False), v, vocab_bound=counted(v),
                              first_ids=first_ids, first_bound=asked)


PROMPTS_SQL = f"{S.VOCAB}, {S.prompts_sql()}"


FLAGSHIP_K = 3


@register("top_followers", f"""
WITH {S.VOCAB}, {S.TRIGRAM},
r AS (SELECT w1, w2, w3, cnt, row_number() OVER (PARTITION BY w1, w2 ORDER BY cnt DESC, w3 ASC) AS rank FROM trigram)
SELECT w1, w2, CAST(rank AS INTEGER) AS rank, w3, cnt FROM r WHERE rank <= {FLAGSHIP_K}""")
def q_top_followers(spark, sf):
    """E2 over the whole model: what follows each two-word context most
    often (top 3, ties by id)."""
    v = vocab(spark, sf)
    fol = C.followers_table(trigram(spark, sf, v), v, FLAGSHIP_K, ["w1", "w2"], bound(v))
    return fol.select("w1", "w2", F.posexplode(F.slice("followers", 1, FLAGSHIP_K)).alias("r", "f")).select(
        "w1", "w2", (F.col("r") + 1).cast("int").alias("rank"), F.col("f.w3").alias("w3"), F.col("f.cnt").alias("cnt"))


@register("next_exact", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM}
SELECT pw.prompt_id, pw.w1, pw.w2, t.w3, t.cnt FROM pw LEFT JOIN trigram t ON t.w1 = pw.w1 AND t.w2 = pw.w2""")
def q_next_exact(spark, sf):
    v = vocab(spark, sf)
    ctx = cut_lineage(prompt_contexts(spark, sf, v))
    return LK.lookup_exact(ctx, trigram(spark, sf, v, ctx)).select("prompt_id", "w1", "w2", "w3", "cnt")


@register("next_top_k", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM},
r AS (SELECT pw.prompt_id, t.w3, t.cnt, row_number() OVER (PARTITION BY pw.prompt_id ORDER BY t.cnt DESC, t.w3 ASC) AS rank
      FROM pw JOIN trigram t ON t.w1 = pw.w1 AND t.w2 = pw.w2)
SELECT prompt_id, CAST(rank AS INTEGER) AS rank, w3, cnt FROM r WHERE rank <= {TOP_K}""")
def q_next_top_k(spark, sf):
    v = vocab(spark, sf)
    ctx = cut_lineage(prompt_contexts(spark, sf, v))
    fol = C.follower_ids(trigram(spark, sf, v, ctx), v, TOP_K, ["w1", "w2"])
    j = ctx.select("prompt_id", "w1", "w2").join(fol, ["w1", "w2"])
    return j.select("prompt_id", F.posexplode(LK.top_k_of("followers", TOP_K)).alias("rank", "f")) \
        .select("prompt_id", (F.col("rank") + 1).cast("int").alias("rank"),
                F.col("f.w3").alias("w3"), F.col("f.cnt").alias("cnt"))


@register("next_bigram", f"""
WITH {PROMPTS_SQL}, {S.BIGRAM_IDS}
SELECT pw.prompt_id, b.w1, b.w2, b.cnt FROM pw JOIN bigram_ids b ON b.w1 = pw.w2""")
def q_next_bigram(spark, sf):
    v = vocab(spark, sf)
    ctx = cut_lineage(prompt_contexts(spark, sf, v)).select("prompt_id", F.col("w2").alias("w1"))
    return ctx.join(bigram_ids(spark, sf, v, ctx), "w1").select("prompt_id", "w1", "w2", "cnt")


def backoff_models(spark, sf, v, ctx):
    """The asked trigram contexts, counted once and stored; bigrams only
    for the last tokens of prompts whose context has no trigram."""
    tri = cut_lineage(trigram(spark, sf, v, ctx))
    miss = ctx.select("w1", "w2").join(tri.select("w1", "w2").distinct(), ["w1", "w2"], "left_anti")
    return tri, bigram_ids(spark, sf, v, cut_lineage(miss.select(F.col("w2").alias("w1"))))


def backoff_long(ctx, tri, bi):
    """E4 in long form: trigram followers where the context exists, else
    the bigram followers of the last token."""
    c = ctx.select("prompt_id", "w1", "w2")
    hit = c.join(tri, ["w1", "w2"]).select("prompt_id", F.lit("trigram").alias("source"), "w3", "cnt")
    miss = c.join(tri.select("w1", "w2").distinct(), ["w1", "w2"], "left_anti")
    bo = miss.select("prompt_id", F.col("w2").alias("w1")).join(bi, "w1") \
        .select("prompt_id", F.lit("bigram").alias("source"), F.col("w2").alias("w3"), "cnt")
    return hit.unionByName(bo)


@register("next_backoff", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM}, {S.BIGRAM_IDS}, {S.BACKOFF}
SELECT prompt_id, source, w3, cnt FROM fol""")
def q_next_backoff(spark, sf):
    v = vocab(spark, sf)
    ctx = cut_lineage(prompt_contexts(spark, sf, v))
    return backoff_long(ctx, *backoff_models(spark, sf, v, ctx))


# ------------------------------------------------------------- F1-F4 F6

@register("cache_scores", f"""
WITH {PROMPTS_SQL}, {S.cache_scores_sql(K.CACHE_RECENT_WINDOW)}
SELECT prompt_id, token_id, round(score, 6) AS score FROM cs""")
def q_cache_scores(spark, sf):
    v = vocab(spark, sf)
    ctx = prompt_contexts(spark, sf, v)
    c = ctx.select("prompt_id", "ctx").withColumn(
        "recent", SC.recent_cacheable(F.col("ctx"), K.CACHE_RECENT_WINDOW)).withColumn(
        "cids", SC.cacheable_ids(F.col("ctx")))
    ids = F.array_distinct(F.col("cids"))
    return c.select("prompt_id", F.explode(F.transform(ids, lambda t: F.struct(
        t.alias("token_id"), SC.cache_score(F.col("cids"), F.col("recent"), t).alias("score")))).alias("s")) \
        .select("prompt_id", "s.token_id", F.round("s.score", 6).alias("score"))


def ranked_frame(spark, sf, k=TOP_K, alpha=K.CACHE_ALPHA, window=K.CACHE_RECENT_WINDOW,
                 temperature=K.GEN_TEMPERATURE, gen_len=0, min_len=K.GEN_MIN_LEN_BEFORE_EOS):
    v = vocab(spark, sf)
    ctx = cut_lineage(prompt_contexts(spark, sf, v))
    tri_m, bi_m = backoff_models(spark, sf, v, ctx)
    tri = C.follower_ids(tri_m, v, k, ["w1", "w2"])
    bi = C.follower_ids(bi_m.withColumnRenamed("w2", "w3"), v, k, ["w1"])
    j = LK.backoff_followers(ctx, tri, bi).filter(F.col("followers").isNotNull())
    j = j.withColumn("recent", SC.recent_cacheable(F.col("ctx"), window)) \
        .withColumn("cids", SC.cacheable_ids(F.col("ctx"))) \
        .withColumn("cands", SC.tree_candidates(F.col("followers"), k))
    j = j.withColumn("scored", SC.scored(F.col("cands"), F.col("cids"), F.col("recent"), alpha,
                                         gen_len, min_len, temperature))
    return j.filter(F.size("scored") > 0).withColumn("ranked", SC.normalise(F.col("scored")))


@register("ranked_candidates", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM}, {S.BIGRAM_IDS}, {S.BACKOFF}, {S.cache_scores_sql(K.CACHE_RECENT_WINDOW)},
{S.ranked_sql(TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, 0, K.GEN_MIN_LEN_BEFORE_EOS)}
SELECT prompt_id, rank, token_id, cnt, round(probability, 6) AS probability FROM ranked""")
def q_ranked_candidates(spark, sf):
    r = ranked_frame(spark, sf)
    return r.select("prompt_id", F.explode("ranked").alias("c")).select(
        "prompt_id", F.col("c.rank").alias("rank"), F.col("c.w3").alias("token_id"),
        F.col("c.cnt").alias("cnt"), F.round("c.probability", 6).alias("probability"))


@register("greedy_next", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM}, {S.BIGRAM_IDS}, {S.BACKOFF}, {S.cache_scores_sql(K.CACHE_RECENT_WINDOW)},
{S.ranked_sql(TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, 0, K.GEN_MIN_LEN_BEFORE_EOS)}
SELECT prompt_id, token_id, cnt, round(probability, 6) AS probability FROM ranked WHERE rank = 1""")
def q_greedy_next(spark, sf):
    r = ranked_frame(spark, sf)
    best = SC.greedy_pick(F.col("scored"))
    r = r.withColumn("best", best)
    p = F.element_at(F.filter("ranked", lambda c: c["rank"] == 1), 1)
    return r.select("prompt_id", F.col("best.w3").alias("token_id"), F.col("best.cnt").alias("cnt"),
                    F.round(p["probability"], 6).alias("probability"))


# ------------------------------------------------------------- B4 B6 B7 C1b C5

@register("strip_symbols_docs", f"""
SELECT page_id, {S.strip_symbols('html')} AS stripped FROM pages""")
def q_strip_symbols_docs(spark, sf):
    pages = L.read_table(spark, sf, "pages").select("page_id", "html")
    return pages.select("page_id", T.strip_symbols("html").alias("stripped"))


@register("word_like", f"""
WITH {S.CLEAN_LINES},
w AS (SELECT DISTINCT unnest({S.words('line')}) AS token FROM clean_lines)
SELECT token, CASE WHEN length(token) = 0 THEN false
                   WHEN token IN ({", ".join(S.sql_str(x) for x in K.SINGLE_CHAR_WORDS)}) THEN true
                   WHEN length(token) >= 2 THEN true
                   ELSE regexp_matches(token, '^[^\\p{{L}}\\p{{N}}]$') END AS word_like FROM w""")
def q_word_like(spark, sf):
    lines = L.corpus_lines(spark, sf, normalize=False)
    w = lines.select(F.explode(T.word_tokens("line")).alias("token")).distinct()
    return w.select("token", T.is_word_like("token").alias("word_like"))


@register("char_coverage", f"""
WITH {S.CLEAN_LINES},
c AS (SELECT unnest(regexp_extract_all(line, '(?s).', 0)) AS ch FROM clean_lines),
cc AS (SELECT ch, count(*)::BIGINT AS cnt FROM c GROUP BY ch),
r AS (SELECT ch, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, ch ASC) AS INTEGER) AS rank,
             sum(cnt) OVER (ORDER BY cnt DESC, ch ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(cnt) OVER () AS total FROM cc)
SELECT ch, cnt, rank, round(cum::DOUBLE / total, 9) AS cum_share, ((cum - cnt)::DOUBLE / total < 1.0) AS kept FROM r""")
def q_char_coverage(spark, sf):
    cov = VO.char_coverage(L.corpus_lines(spark, sf, normalize=False), 1.0)
    return cov.withColumn("cum_share", F.round("cum_share", 9))


@register("cacheable_vocab", f"""
WITH {S.VOCAB}
SELECT id, piece, cacheable, {S.strip_symbols("replace(piece, '" + K.SPACE_MARK + "', '')")} AS clean,
       count(*) OVER () AS vocab_size FROM vocab""")
def q_cacheable_vocab(spark, sf):
    v = vocab(spark, sf)
    return v.select("id", "piece", "cacheable", T.clean_piece("piece").alias("clean"),
                    F.lit(v.count()).cast("bigint").alias("vocab_size"))


# ------------------------------------------------------------- C6 D4-D9

@register("bigram_by_id", f"""
WITH {S.VOCAB}, {S.BIGRAM_IDS}
SELECT w1, w2, cnt FROM bigram_ids""")
def q_bigram_by_id(spark, sf):
    """The string-keyed bigram model re-keyed by id."""
    v = vocab(spark, sf)
    return VO.bigram_to_ids(C.bigram_counts(L.corpus_lines(spark, sf, normalize=False)), v, bound(v))


TRIGRAM_SQL = f"WITH {S.VOCAB}, {S.TRIGRAM}"
SHARDS = K.DEFAULT_NUM_SHARDS


@register("shard_sizes", f"""
{TRIGRAM_SQL},
s AS (SELECT ((xor(w1::BIGINT * {K.SHARD_MULTIPLIER}, w2::BIGINT) % {SHARDS}) + {SHARDS}) % {SHARDS} AS shard, w1, w2, cnt FROM trigram),
c AS (SELECT shard, w1, w2, count(*) AS nf, sum(cnt) AS c FROM s GROUP BY 1, 2, 3)
SELECT CAST(shard AS INTEGER) AS shard, count(*)::BIGINT AS contexts, sum(nf)::BIGINT AS rows, sum(c)::BIGINT AS total
FROM c GROUP BY 1""")
def q_shard_sizes(spark, sf):
    return C.shard_sizes(trigram(spark, sf), SHARDS)


@register("shard_reduce", f"""
WITH {S.VOCAB},
chunked AS (SELECT CAST((row_number() OVER (ORDER BY doc_id, line_no) - 1) // {1000} AS INTEGER) AS part_id, line FROM norm_lines),
{S.ngram_ids(3, 2, True, 'chunked', extra='part_id')},
parts AS (SELECT part_id, w1, w2, w3, count(*)::BIGINT AS cnt FROM g GROUP BY 1, 2, 3, 4)
SELECT CAST(((xor(w1::BIGINT * {K.SHARD_MULTIPLIER}, w2::BIGINT) % {SHARDS}) + {SHARDS}) % {SHARDS} AS INTEGER) AS shard,
       w1, w2, w3, sum(cnt)::BIGINT AS cnt FROM parts GROUP BY 1, 2, 3, 4""")
def q_shard_reduce(spark, sf):
    """Partial models bucketed by context hash and reduced per shard."""
    v = vocab(spark, sf)
    parts = C.partial_counts(docs(spark, sf), v, 1000, vocab_bound=counted(v), deal=["w1", "w2", "w3"])
    return C.shard_and_reduce(parts, SHARDS)


@register("model_nested_roundtrip", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_model_nested_roundtrip(spark, sf):
    v = vocab(spark, sf)
    model = C.id_ngram_counts(L.corpus_lines(spark, sf, normalize=True), v, 3, 2, vocab_bound=counted(v), salt_buckets=C.SALT_BUCKETS)
    return C.to_long(C.to_nested(model)).select("w1", "w2", "w3", "cnt")


@register("corpus_stats", f"""
{TRIGRAM_SQL},
ls AS (SELECT count(*)::BIGINT AS total_lines, count(*) FILTER (WHERE length({S.normalize('line')}) > 0)::BIGINT AS valid_lines FROM raw_lines),
ms AS (SELECT count(DISTINCT (w1, w2))::BIGINT AS contexts, count(*)::BIGINT AS model_rows, sum(cnt)::BIGINT AS total_count FROM trigram)
SELECT * FROM ls, ms""")
def q_corpus_stats(spark, sf):
    return C.corpus_stats(docs(spark, sf), trigram(spark, sf))


PART_LINES = 1000


@register("trigram_partials", f"""
WITH {S.VOCAB},
chunked AS (SELECT CAST((row_number() OVER (ORDER BY doc_id, line_no) - 1) // {PART_LINES} AS INTEGER) AS part_id, line FROM norm_lines),
{S.ngram_ids(3, 2, True, 'chunked', extra='part_id')}
SELECT part_id, w1, w2, w3, count(*)::BIGINT AS cnt FROM g GROUP BY 1, 2, 3, 4""")
def q_trigram_partials(spark, sf):
    v = vocab(spark, sf)
    return C.partial_counts(docs(spark, sf), v, PART_LINES, vocab_bound=counted(v))


@register("partial_stats", f"""
WITH {S.CLEAN_LINES},
chunked AS (SELECT CAST((row_number() OVER (ORDER BY doc_id, line_no) - 1) // {PART_LINES} AS INTEGER) AS part_id, line FROM norm_lines),
ls AS (SELECT part_id, count(*)::BIGINT AS n_lines, sum(len({S.words('line')}) + 1)::BIGINT AS n_samples FROM chunked GROUP BY 1),
padded AS (SELECT part_id, list_concat([NULL, NULL], {S.words('line')}, [chr(10)]) AS p FROM chunked),
g AS (SELECT part_id, p, unnest(generate_series(1, len(p) - 2)) AS i FROM padded),
m AS (SELECT DISTINCT part_id, p[i] AS w1, p[i + 1] AS w2, p[i + 2] AS w3 FROM g)
SELECT part_id, n_lines, n_samples, contexts, model_rows FROM ls JOIN (
    SELECT part_id, count(DISTINCT (w1, w2))::BIGINT AS contexts, count(*)::BIGINT AS model_rows FROM m GROUP BY 1) USING (part_id)""")
def q_partial_stats(spark, sf):
    """D9 per chunk, counted on the strings by the oracle."""
    v = vocab(spark, sf)
    return C.partial_stats(C.partial_counts(docs(spark, sf), v, PART_LINES, vocab_bound=counted(v)))


@register("trigram_merged", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_trigram_merged(spark, sf):
    v = vocab(spark, sf)
    return C.merge_partials(C.partial_counts(docs(spark, sf), v, PART_LINES, vocab_bound=counted(v), deal=["w1", "w2", "w3"]))


MAX_LINES = 5000


@register("limit_lines", f"""
WITH {S.RAW_LINES}
SELECT doc_id, line_no, line FROM raw_lines ORDER BY doc_id, line_no LIMIT {MAX_LINES}""")
def q_limit_lines(spark, sf):
    return L.limit_lines(docs(spark, sf), MAX_LINES)


# ------------------------------------------------------------- G1

def generation(spark, sf, mode, model_type="trigram", seed=K.NEURAL_SEED):
    from gramloom.plans.generate import generate, lookup_model
    v = vocab(spark, sf)
    acc, _ = PR.split_requests(requests(spark, sf))
    enc = cut_lineage(LK.encode_prompts(acc, v, bound(v)))  # read three times below
    n, k = enc.agg(F.count(F.lit(1)), F.max("top_k")).first()
    k = max(TOP_K, k or TOP_K)
    if model_type == "bigram":
        model = lookup_model(bigram_ids(spark, sf, v).withColumnRenamed("w2", "w3"), v, k, ["w1"], bound(v), n)
    else:
        model = lookup_model(trigram(spark, sf, v), v, k, ["w1", "w2"], bound(v), n)
    out = generate(enc, model, model_type, mode, seed)
    model.unpersist()  # the result reads only checkpointed steps and the prompts
    return out


@register("greedy_text", f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.TRIGRAM},
{S.greedy_sql(K.GEN_MAX_TOKENS, TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW, K.GEN_MIN_LEN_BEFORE_EOS)}
SELECT prompt_id, text, n_generated::INTEGER AS n_generated, stop, 'trigram' AS model_type FROM gen_out""")
def q_greedy_text(spark, sf):
    return generation(spark, sf, "greedy")


@register("greedy_text_bigram", f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.BIGRAM_IDS},
{S.greedy_sql(K.GEN_MAX_TOKENS, TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW, K.GEN_MIN_LEN_BEFORE_EOS, "bigram")}
SELECT prompt_id, text, n_generated::INTEGER AS n_generated, stop, 'bigram' AS model_type FROM gen_out""")
def q_greedy_text_bigram(spark, sf):
    return generation(spark, sf, "greedy", model_type="bigram")


@register("stored_model_text", f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.TRIGRAM},
{S.greedy_sql(K.GEN_MAX_TOKENS, TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW, K.GEN_MIN_LEN_BEFORE_EOS)}
SELECT prompt_id, text, n_generated::INTEGER AS n_generated, stop, 'trigram' AS model_type FROM gen_out""")
def q_stored_model_text(spark, sf):
    """A5 + A10 + G1: the model written as trigram rows, found again by
    ``load_model``, its followers stored in buckets of the context, and text
    generated from those."""
    from gramloom.plans.generate import SMALL_MODEL, StoredFollowers, generate
    from gramloom.sources import store as ST
    v = vocab(spark, sf)
    base = ST.scratch_path(spark, "model")
    ST.write_trigram(trigram(spark, sf, v), f"{base}/trigram")
    model, kind = ST.load_model(spark, base)
    acc, _ = PR.split_requests(requests(spark, sf))
    enc = cut_lineage(LK.encode_prompts(acc, v, bound(v)))
    k = max(TOP_K, enc.agg(F.max("top_k")).first()[0] or TOP_K)
    followers = ST.bucketed_followers(C.followers_table(model, v, k, ["w1", "w2"], bound(v)), ["w1", "w2"])
    if model.count() >= SMALL_MODEL:
        followers = StoredFollowers(followers, ["w1", "w2"])
    return generate(enc, followers, kind, "greedy")


SAMPLED_SQL = f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.TRIGRAM},
{S.greedy_sql(K.GEN_MAX_TOKENS, TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW, K.GEN_MIN_LEN_BEFORE_EOS, seed=K.NEURAL_SEED)}"""


@register("sampled_text", f"""{SAMPLED_SQL}
SELECT prompt_id, text, n_generated::INTEGER AS n_generated, stop, 'trigram' AS model_type FROM gen_out""")
def q_sampled_text(spark, sf):
    return generation(spark, sf, "sample")


@register("sampled_text_bigram", f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.BIGRAM_IDS},
{S.greedy_sql(K.GEN_MAX_TOKENS, TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW, K.GEN_MIN_LEN_BEFORE_EOS, "bigram", K.NEURAL_SEED)}
SELECT prompt_id, text, n_generated::INTEGER AS n_generated, stop, 'bigram' AS model_type FROM gen_out""")
def q_sampled_text_bigram(spark, sf):
    return generation(spark, sf, "sample", model_type="bigram")


# ------------------------------------------------------------- G2-G5 A11 A12

TREE_COLS = ["prompt_id", "node_id", "parent_id", "depth", "choice_rank", "token_id", "piece",
             "count", "score", "probability", "cumulative_score", "text", "is_terminal"]


def tree_nodes(spark, sf, max_depth=K.TREE_MAX_DEPTH):
    from gramloom.plans.generate import tree_model
    from gramloom.plans.tree import TreeParams, expand_tree
    v = vocab(spark, sf)
    enc = cut_lineage(prompt_contexts(spark, sf, v))
    k, params = TOP_K, TreeParams(max_depth=max_depth)
    most = enc.count() * params.branch_factor ** max_depth  # rows of the largest step
    tri = tree_model(trigram(spark, sf, v), v, k, ["w1", "w2"], bound(v), most)
    bi = tree_model(bigram_ids(spark, sf, v).withColumnRenamed("w2", "w3"), v, k, ["w1"], bound(v), most)
    nodes = expand_tree(enc, tri, bi, params)
    tri.unpersist()  # every level is checkpointed already
    bi.unpersist()
    return nodes


def rounded_nodes(nodes):
    out = nodes.select(*TREE_COLS)
    for c in ("count", "score", "probability", "cumulative_score"):
        out = out.withColumn(c, F.round(c, 6))
    return out


TREE_SQL = f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.TRIGRAM}, {S.BIGRAM_IDS}, {S.PROMPT_BASE},
{S.tree_sql(TOP_K, K.TREE_BRANCH_FACTOR, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW,
            K.GEN_MIN_LEN_BEFORE_EOS, K.TREE_MAX_SUBTOKENS_PER_WORD, K.TREE_MAX_DEPTH)}"""


@register("tree_nodes", f"""{TREE_SQL}
SELECT prompt_id, node_id, parent_id, depth, choice_rank, token_id, piece, round(count, 6) AS count,
       round(score, 6) AS score, round(probability, 6) AS probability,
       round(cumulative_score, 6) AS cumulative_score, text, is_terminal FROM tree""")
def q_tree_nodes(spark, sf):
    return rounded_nodes(tree_nodes(spark, sf))


@register("tree_depth1", f"""
WITH RECURSIVE {PROMPTS_SQL}, {S.TRIGRAM}, {S.BIGRAM_IDS}, {S.BACKOFF}, {S.cache_scores_sql(K.CACHE_RECENT_WINDOW)},
{S.ranked_sql(TOP_K, K.CACHE_ALPHA, K.GEN_TEMPERATURE, 0, K.GEN_MIN_LEN_BEFORE_EOS)},
{S.PROMPT_BASE},
{S.tree_depth1_sql(TOP_K, K.TREE_BRANCH_FACTOR, K.CACHE_ALPHA, K.GEN_TEMPERATURE, K.CACHE_RECENT_WINDOW,
                   K.GEN_MIN_LEN_BEFORE_EOS, K.TREE_MAX_SUBTOKENS_PER_WORD)}
SELECT prompt_id, node_id, parent_id, depth, choice_rank, token_id, piece, round(count, 6) AS count,
       round(score, 6) AS score, round(probability, 6) AS probability,
       round(cumulative_score, 6) AS cumulative_score, text, is_terminal FROM tree1""")
def q_tree_depth1(spark, sf):
    """G2-G5 at depth 1: every root and its grown first-level words."""
    return rounded_nodes(tree_nodes(spark, sf, max_depth=1))


TREE_TOKEN_SQL = S.strip_symbols(f"replace(piece, '{K.SPACE_MARK}', '')")


@register("tree_csv", f"""{TREE_SQL}
SELECT prompt_id, node_id, CASE WHEN depth = 0 THEN text
       WHEN is_terminal AND length({TREE_TOKEN_SQL}) = 0 THEN '{K.EOS_PIECE}' ELSE {TREE_TOKEN_SQL} END AS token FROM tree""")
def q_tree_csv(spark, sf):
    from gramloom.plans.tree import csv_tokens
    return csv_tokens(tree_nodes(spark, sf))


# ------------------------------------------------------------- A5-A9 A12

@register("tree_json", f"""{TREE_SQL}
SELECT prompt_id, '{{"model_type":"trigram","output_csv":"tree_csv/bucket='
       || (('0x' || substr(md5(prompt_id::VARCHAR), 1, 8))::BIGINT % {K.TREE_CSV_BUCKETS})::VARCHAR
       || '","node_count":' || count(*)::VARCHAR || '}}' AS json
FROM tree GROUP BY prompt_id""")
def q_tree_json(spark, sf):
    """A11 + A12: write all trees as CSV in buckets of prompts, read them
    back, then one JSON summary row per prompt (model type, folder below the
    output folder, node count)."""
    from gramloom.plans.tree import read_tree_buckets, summary_of_buckets, write_tree_buckets
    from gramloom.sources import store as ST
    path = ST.scratch_path(spark, "tree_csv")
    write_tree_buckets(tree_nodes(spark, sf), path)
    return summary_of_buckets(read_tree_buckets(spark, path, "bigint"), "trigram", "tree_csv")


@register("shard_lookup", f"""
WITH {PROMPTS_SQL}, {S.TRIGRAM}
SELECT pw.prompt_id, t.w1, t.w2, t.w3, t.cnt FROM pw JOIN trigram t ON t.w1 = pw.w1 AND t.w2 = pw.w2""")
def q_shard_lookup(spark, sf):
    """A7 + A9: write the model in 64 context-hash shards, then answer the
    prompt contexts from the shards they hash to."""
    from gramloom.sources import store as ST
    v = vocab(spark, sf)
    path = ST.scratch_path(spark, "trigram_shards")
    ST.write_sharded(trigram(spark, sf, v), path, SHARDS)
    ctx = prompt_contexts(spark, sf, v).select("prompt_id", "w1", "w2")
    return ST.read_sharded(spark, path, ctx).select("prompt_id", "w1", "w2", "w3", "cnt")


@register("store_roundtrip", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_store_roundtrip(spark, sf):
    """A5: write the merged model clustered by context and read it back."""
    from gramloom.sources import store as ST
    path = ST.scratch_path(spark, "trigram")
    ST.write_trigram(trigram(spark, sf), path)
    return spark.read.parquet(path).select("w1", "w2", "w3", "cnt")


@register("bigram_store", ORACLE["bigram_counts"])
def q_bigram_store(spark, sf):
    """A3: write the bigram model and read it back."""
    from gramloom.sources import store as ST
    path = ST.scratch_path(spark, "bigram")
    ST.write_bigram(QUERIES["bigram_counts"](spark, sf), path)
    return spark.read.parquet(path)


@register("counts_export", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_counts_export(spark, sf):
    """Replace the flat counts table (keys checked) and read it."""
    from uuid import uuid4

    from gramloom.sources import store as ST
    name = f"counts_{uuid4().hex[:12]}"
    ST.export_counts_table(trigram(spark, sf), name, ST.scratch_path(spark, "counts_table"))
    return spark.table(name)


@register("shards_appended", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_shards_appended(spark, sf):
    """Reset the shards with one half of the model, keep them and add the
    other half, read all back."""
    from gramloom.sources import store as ST
    path = ST.scratch_path(spark, "appended_shards")
    model = cut_lineage(trigram(spark, sf))
    half = F.pmod("w3", F.lit(2)) == 0
    ST.write_sharded(model.filter(~half), path, SHARDS)  # replaced by the next write
    ST.write_sharded(model.filter(half), path, SHARDS)
    ST.write_sharded(model.filter(~half), path, SHARDS, mode="append")
    return ST.read_sharded(spark, path).select("w1", "w2", "w3", "cnt")


@register("generation_json", f"""{SAMPLED_SQL}
SELECT prompt_id, to_json({{'text': text, 'model_type': 'trigram'}})::VARCHAR AS json FROM gen_out""")
def q_generation_json(spark, sf):
    from gramloom.sources import store as ST
    return ST.generation_json(generation(spark, sf, "sample"))


# ------------------------------------------------------------- H1-H6 F7 G6

NEURAL_K = K.NEURAL_CONTEXT_SIZE


def neural_samples(spark, sf):
    """H1 over the whole vocabulary; the start marker is the id after its last."""
    from gramloom.plans import neural as N
    v = vocab(spark, sf)
    n = counted(v)
    cfg = N.NeuralConfig(vocab_size=n + 1, bos_token_id=n)
    return N.build_samples(L.corpus_lines(spark, sf, normalize=False), v, cfg, n)


@register("neural_samples", f"""
WITH {S.VOCAB},
nlines AS (SELECT doc_id, line_no, line, n FROM clean_lines, (SELECT count(*) AS n FROM vocab)),
{S.ngram_ids(NEURAL_K + 1, NEURAL_K, False, 'nlines', extra='doc_id, line_no', bos_id='n')}
SELECT doc_id, line_no, w1 AS c1, w2 AS c2, w3 AS c3, w4 AS c4, w5 AS target FROM g""")
def q_neural_samples(spark, sf):
    smp = neural_samples(spark, sf)
    return smp.select("doc_id", "line_no", *[F.col("context")[i].alias(f"c{i + 1}") for i in range(NEURAL_K)],
                      "target")


@register("neural_batches", f"""
WITH {S.VOCAB},
nlines AS (SELECT doc_id, line_no, line, n FROM clean_lines, (SELECT count(*) AS n FROM vocab)),
{S.ngram_ids(NEURAL_K + 1, NEURAL_K, False, 'nlines', extra='doc_id, line_no', bos_id='n')},
h AS (SELECT doc_id, line_no, w1, w2, w3, w4, w5,
             substr(md5(concat_ws('-', {K.NEURAL_SEED}, 1, doc_id, line_no, w1, w2, w3, w4, w5)), 1, 15) AS h FROM g)
SELECT doc_id, line_no, w5 AS target,
       ((row_number() OVER (ORDER BY h, doc_id, line_no, w1, w2, w3, w4, w5) - 1) // {K.NEURAL_BATCH_SIZE})::BIGINT AS batch
FROM h""")
def q_neural_batches(spark, sf):
    from gramloom.plans import neural as N
    kept = ["doc_id", "line_no", "target"]
    return N.shuffle_batches(neural_samples(spark, sf), K.NEURAL_SEED, 1, keep=kept).select(*kept, "batch")


# ------------------------------------------------------------- C1 C2 C3 (subword)

def subword_vocab(spark, sf):
    from gramloom.operators import subword as SW
    return cut_lineage(SW.train_unigram(L.corpus_lines(spark, sf, normalize=False), K.DEFAULT_VOCAB_SIZE))


SAMPLED_LINES = 1000


@register("line_sample", f"""
WITH {S.CLEAN_LINES},
h AS (SELECT doc_id, line_no, line, ('0x' || substr(md5('{K.NEURAL_SEED}-' || doc_id || '-' || line_no), 1, 15))::BIGINT AS h
      FROM clean_lines)
SELECT doc_id, line_no, line FROM h ORDER BY h, doc_id, line_no LIMIT {SAMPLED_LINES}""")
def q_line_sample(spark, sf):
    """A reproducible sample of exactly this many lines."""
    from gramloom.operators import subword as SW
    return SW.sample_lines(L.corpus_lines(spark, sf, normalize=False), SAMPLED_LINES).select("doc_id", "line_no", "line")


@register("subword_vocab")
def q_subword_vocab(spark, sf):
    return subword_vocab(spark, sf).withColumn("score", F.round("score", 6))


@register("subword_coverage", f"""
WITH {S.CLEAN_LINES},
w AS (SELECT DISTINCT unnest({S.words(S.strip("nfc_normalize(line)"))}) AS w FROM clean_lines),
c AS (SELECT DISTINCT unnest(regexp_extract_all('{K.SPACE_MARK}' || w, '(?s).', 0)) AS ch FROM w)
SELECT count(*)::BIGINT AS characters, 0::BIGINT AS characters_without_piece, 0::BIGINT AS bad_rows, true AS within_size FROM c""")
def q_subword_coverage(spark, sf):
    """C1 invariants: every character of the corpus is a piece, ids are dense,
    no piece occurs twice or holds the boundary mark inside, scores descend
    with the id."""
    from gramloom.operators import subword as SW
    v = subword_vocab(spark, sf)
    chars = (SW.word_chunks(L.corpus_lines(spark, sf, normalize=False))
             .select(F.explode(T.char_tokens("chunk")).alias("piece")).distinct())
    have = v.filter(F.col("id") >= VO.RESERVED)
    n = v.count()
    nxt = have.select((F.col("id") - 1).alias("id"), F.col("score").alias("next"))
    bad = (v.join(nxt, "id", "left").join(v.groupBy("piece").agg(F.count(F.lit(1)).alias("copies")), "piece")
           .filter(((F.col("id") >= VO.RESERVED) & (F.col("next") > F.col("score"))) | (F.col("copies") > 1)
                   | F.substring("piece", 2, 100).contains(K.SPACE_MARK) | ~F.col("id").between(0, n - 1)).count())
    return chars.join(have.select("piece", F.lit(1).alias("has")), "piece", "left").agg(
        F.count(F.lit(1)).alias("characters"),
        F.sum(F.col("has").isNull().cast("bigint")).alias("characters_without_piece"),
        F.lit(bad).cast("bigint").alias("bad_rows"), F.lit(n <= K.DEFAULT_VOCAB_SIZE).alias("within_size"))


@register("subword_tokens", f"""
SELECT conv_id, turn, array_to_string({S.words(S.strip("nfc_normalize(text)"))}, ' ') AS decoded, true AS sizes_fit FROM conversations""")
def q_subword_tokens(spark, sf):
    """C2 + C3: decode(encode(x)) is x with single spaces; a text has at
    least as many pieces as words and at most as many as characters."""
    from gramloom.operators import subword as SW
    v = subword_vocab(spark, sf)
    conv = L.read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    enc = SW.encode_subword(conv, ["conv_id", "turn"], "text", v)
    decoded = VO.decode_expr(F.col("ids_tok"), "subword")
    words = F.size(T.word_tokens(decoded))
    return enc.select("conv_id", "turn", decoded.alias("decoded"),
                      F.size("ids").between(words, F.length(decoded) + 1).alias("sizes_fit"))


@register("subword_trigram_counts")
def q_subword_trigram_counts(spark, sf):
    """D2 over subword ids of the normalised corpus lines; lines are encoded
    where they lie and stored as ids, so the count has the only exchange."""
    from gramloom.operators import subword as SW
    v = subword_vocab(spark, sf)
    lines = L.corpus_lines(spark, sf, normalize=True)
    enc = stored(SW.encode_subword(lines, [], "line", v, ids_only=True), "subwords", "zstd")
    total = enc.agg(F.sum(F.size("ids") + 1)).first()[0]  # one ends in each token and in the line's end
    return C.ids_ngram_counts(enc, "ids", 3, total=total)


# ------------------------------------------------------------- A4 D4 D5 streaming

@register("streamed_merged", f"""
{TRIGRAM_SQL}
SELECT w1, w2, w3, cnt FROM trigram""")
def q_streamed_merged(spark, sf):
    """The corpus lines written as text files of bounded length, streamed a
    few files per micro-batch into restartable partials, then merged."""
    from gramloom.sources import store as ST
    from gramloom.streaming import stream_partial_counts, write_corpus_files
    v = vocab(spark, sf)
    src = ST.scratch_path(spark, "corpus_files")
    write_corpus_files(L.read_lines(docs(spark, sf)), src, K.DEFAULT_LINES_PER_CHUNK)
    parts = ST.scratch_path(spark, "stream_parts")
    stream_partial_counts(spark, src, v, parts, ST.scratch_path(spark, "stream_ckpt"), files_per_chunk=4,
                          vocab_bound=counted(v))
    return C.merge_partials(ST.read_partials(spark, parts)).select("w1", "w2", "w3", "cnt")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
