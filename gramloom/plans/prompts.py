"""Request tables.  A request row carries a prompt and optional
generation settings; missing settings take the defaults, invalid prompts go
to a reject table with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import text as T

REQUEST_DEFAULTS = {
    "max_tokens": K.GEN_MAX_TOKENS,
    "top_k": K.GEN_TOP_K,
    "temperature": K.GEN_TEMPERATURE,
    "min_len_before_eos": K.GEN_MIN_LEN_BEFORE_EOS,
    "cache_alpha": K.CACHE_ALPHA,
    "cache_recent_window": K.CACHE_RECENT_WINDOW,
}
REQUEST_TYPES = {"max_tokens": "int", "top_k": "int", "temperature": "double",
                 "min_len_before_eos": "int", "cache_alpha": "double", "cache_recent_window": "int"}


# prompt_id = conv_id * PROMPT_TURNS + turn: unique for turns below 2**20
# and conversation ids below 2**43
PROMPT_TURNS = 1 << 20


def conversation_requests(conversations: DataFrame) -> DataFrame:
    """Every user turn of ``conversations`` as a request (settings unset).
    Ids beyond the bounds of ``prompt_id`` are an error, not a collision."""
    fits = F.col("turn").between(0, PROMPT_TURNS - 1) & F.col("conv_id").between(0, (1 << 43) - 1)
    key = (F.col("conv_id").cast("bigint") * PROMPT_TURNS + F.col("turn")).cast("bigint")
    return conversations.filter(F.col("role") == "user").select(
        F.when(fits, key).otherwise(F.raise_error(F.lit("conv_id or turn is out of range")).cast("bigint")).alias("prompt_id"),
        F.col("text").alias("prompt"),
        *[F.lit(None).cast(t).alias(c) for c, t in REQUEST_TYPES.items()])


def with_defaults(requests: DataFrame, **overrides) -> DataFrame:
    """Fill each missing setting per row (``overrides`` change the
    defaults, e.g. the remote client's 220/20/0.95/80)."""
    out = requests
    for c, t in REQUEST_TYPES.items():
        default = overrides.get(c, REQUEST_DEFAULTS[c])
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
        out = out.withColumn(c, F.coalesce(F.col(c).cast(t), F.lit(default).cast(t)))
    return out


def split_requests(requests: DataFrame, **overrides) -> tuple[DataFrame, DataFrame]:
    """B8 + B12: ``(accepted with defaults, rejected with reason)``.  A
    temperature <= 0 is rejected too (sampling divides by it)."""
    filled = with_defaults(requests, **overrides)
    ok = T.valid_prompt(F.col("prompt"))
    reason = (F.when(~ok, F.lit(K.REJECT_REASON_PROMPT))
              .when(F.col("temperature") <= 0, F.lit("temperature must be positive")))
    tagged = filled.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()).select("prompt_id", "prompt", "reason"))
