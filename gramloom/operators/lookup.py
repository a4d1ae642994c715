"""Lookups of contexts in a model.  The reference probes a dict per
context; here a table of contexts is equi-joined with the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import arrays as A
from gramloom.operators.vocab import encode_tokens, tokens_expr
from gramloom.functions import text as T


def sentinel_tok(token_id: int):
    return F.struct(F.lit(token_id).cast("int").alias("id"), F.lit("").alias("piece"),
                    F.lit(False).alias("cacheable"))


def encode_prompts(prompts: DataFrame, vocab: DataFrame, vocab_bound: int | None,
                   tokenizer: str = "word", key: str = "prompt_id") -> DataFrame:
    """Encode ``prompt`` (stripped, not normalised) and build the context
    ``ctx`` = [BOS, BOS] ++ prompt tokens as ``array<struct<id, piece,
    cacheable>>`` plus its last two ids ``w1``, ``w2`` (E6)."""
    toks = prompts.withColumn("_tokens", tokens_expr(T.strip(F.col("prompt")), tokenizer))
    enc = encode_tokens(toks, [key], "_tokens", vocab, vocab_bound, out_col="pids").drop("_tokens")
    enc = enc.withColumn("ctx", F.concat(F.array(sentinel_tok(K.BOS_ID), sentinel_tok(K.BOS_ID)),
                                         F.col("pids_tok")))
    w1, w2 = A.last_context(F.transform("ctx", lambda x: x["id"]))
    return enc.withColumn("w1", w1).withColumn("w2", w2)


def last_token(ctx_col: str = "ctx"):
    return F.coalesce(F.element_at(F.transform(ctx_col, lambda x: x["id"]), -1), F.lit(K.BOS_ID))


def lookup_exact(contexts: DataFrame, model: DataFrame, key: str = "prompt_id") -> DataFrame:
    """All followers of each context; a missing context yields one row
    with null follower (left join)."""
    return contexts.select(key, "w1", "w2").join(model, ["w1", "w2"], "left")


def top_k_of(followers_col: str, k) -> F.Column:
    """First ``k`` followers (arrays are kept sorted by cnt desc, id asc)."""
    kk = F.lit(k) if isinstance(k, int) else F.col(k)
    return F.slice(F.col(followers_col), 1, kk)


def backoff_followers(contexts: DataFrame, tri_followers: DataFrame, bi_followers: DataFrame,
                      ctx_col: str = "ctx") -> DataFrame:
    """Trigram followers of (w1, w2) when the context exists, else the
    bigram followers of the last token.  Two left joins and a coalesce; the
    ``source`` column says which model answered."""
    tri = tri_followers.withColumnRenamed("followers", "_tri")
    bi = bi_followers.select(F.col("w1").alias("_last"), F.col("followers").alias("_bi"))
    j = (contexts.join(tri, ["w1", "w2"], "left")
         .withColumn("_last", last_token(ctx_col))
         .join(bi, "_last", "left"))
    return (j.withColumn("source", F.when(F.col("_tri").isNotNull(), F.lit("trigram"))
                         .when(F.col("_bi").isNotNull(), F.lit("bigram")))
            .withColumn("followers", F.coalesce("_tri", "_bi"))
            .drop("_tri", "_bi", "_last"))

