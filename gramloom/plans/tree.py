"""G2-G5 + A11/A12: prediction trees for a table of prompts.

Breadth-first, one DataFrame per depth.  For every non-terminal node of the
previous depth: look up followers (trigram, else bigram back-off), rank them
(F4, ``generated_len`` = parent depth), take the first ``branch_factor``,
and grow each into a word (G2).  Word growth is at most
``max_subtokens - 1`` further lookups, each over the rows still growing
only.  Node ids are BFS numbers: per prompt, nodes of earlier depths first,
then by parent id and choice rank (a window over one prompt's level, which
holds at most ``branch_factor ** depth`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions import arrays as A
from gramloom.functions import text as T
from gramloom.operators import counts as C
from gramloom.operators import score as SC
from gramloom.operators.vocab import decode_pieces
from gramloom.plans.generate import AskedModel, CountedModel, even_parts
from gramloom.sources.store import WRITERS_PER_SHARD, stored

NODE_COLS = ["prompt_id", "node_id", "parent_id", "depth", "choice_rank", "token_id", "piece",
             "count", "score", "probability", "cumulative_score", "text", "is_terminal", "ctx", "gen"]


class TreeParams:
    def __init__(self, max_depth=K.TREE_MAX_DEPTH, branch_factor=K.TREE_BRANCH_FACTOR,
                 top_k=K.GEN_TOP_K, temperature=K.GEN_TEMPERATURE,
                 min_len_before_eos=K.GEN_MIN_LEN_BEFORE_EOS, cache_alpha=K.CACHE_ALPHA,
                 cache_recent_window=K.CACHE_RECENT_WINDOW,
                 max_subtokens_per_word=K.TREE_MAX_SUBTOKENS_PER_WORD):
        self.max_depth = max_depth
        self.branch_factor = branch_factor
        self.top_k = top_k
        self.temperature = temperature
        self.min_len = min_len_before_eos
        self.alpha = cache_alpha
        self.window = cache_recent_window
        self.max_subtokens = max_subtokens_per_word


def rank_with_backoff(df: DataFrame, tri, bi, gen_len, p: TreeParams) -> DataFrame:
    """E4 + F4: add ``ranked`` (null when no follower or no eligible one).
    ``df`` is stored, as an ``AskedModel`` reads it more than once."""
    w1, w2 = A.last_context_of("ctx")
    j = df.withColumn("w1", w1).withColumn("w2", w2)
    if isinstance(tri, AskedModel):
        j = tri.look_up(j, ["w1", "w2"], "_tri")
    else:
        j = j.join(tri.withColumnRenamed("followers", "_tri"), ["w1", "w2"], "left")
    if bi is not None:
        j = j.withColumn("_last", A.last_id("ctx"))
        if isinstance(bi, AskedModel):  # asked where no trigram answers
            j = bi.look_up(j, ["_last"], "_bi", F.col("_tri").isNull())
        else:
            j = j.join(bi.select(F.col("w1").alias("_last"), F.col("followers").alias("_bi")), "_last", "left")
        j = j.withColumn("_fol", F.coalesce("_tri", "_bi")).drop("_last", "_bi")
    else:
        j = j.withColumn("_fol", F.col("_tri"))
    j = j.drop("w1", "w2", "_tri")
    j = (j.withColumn("_cands", SC.tree_candidates(F.coalesce("_fol", F.array()), p.top_k))
         .withColumn("_recent", SC.recent_cacheable(F.col("ctx"), p.window))
         .withColumn("_cids", SC.cacheable_ids(F.col("ctx"))))
    j = j.withColumn("_scored", SC.scored(F.col("_cands"), F.col("_cids"), F.col("_recent"), p.alpha,
                                          gen_len, p.min_len, p.temperature))
    return (j.withColumn("ranked", F.when(F.size("_scored") > 0, SC.normalise(F.col("_scored"))))
            .drop("_fol", "_cands", "_recent", "_cids", "_scored"))


def with_piece(rows: DataFrame, cand: str, tri, bi) -> DataFrame:
    """``rows`` (stored here) with the piece of the candidate ``cand``, which
    the followers of a ``CountedModel`` don't hold."""
    models = [m for m in (tri, bi) if isinstance(m, CountedModel)]
    if not models:
        return rows
    rows = stored(rows.withColumn("w3", F.col(cand)["w3"]), "picks", "zstd")
    return (C.pieces_of(rows, models[0].vocab)
            .withColumn(cand, F.col(cand).withField("piece", F.coalesce(F.col(cand)["piece"], F.col("_piece")))).drop("w3", "_piece"))


def _tok(c):
    return F.struct(c["w3"].alias("id"), c["cacheable"].alias("cacheable"))


def _neglog(p):
    return -F.log(F.greatest(p, F.lit(K.MIN_PROBABILITY)))


def grow_words(children: DataFrame, tri, bi, p: TreeParams, tokenizer: str) -> DataFrame:
    """G2 for every child row (``cand`` = its first ranked token)."""
    cand = F.col("cand")
    eos = cand["w3"] == K.EOS_ID
    word = T.is_word_like(T.strip_symbols(decode_pieces(F.col("added"), tokenizer)))
    base = with_piece(children, "cand", tri, bi).select(
        "prompt_id", "parent_id", "depth", "choice_rank", "parent_score",
        cand["w3"].alias("token_id"),
        F.when(eos, F.col("ctx")).otherwise(F.concat("ctx", F.array(_tok(cand)))).alias("ctx"),
        F.when(eos, F.col("gen")).otherwise(F.concat("gen", F.array(cand["piece"]))).alias("gen"),
        F.when(eos, F.array().cast("array<string>")).otherwise(F.array(cand["piece"])).alias("added"),
        cand["cnt"].cast("double").alias("count"),
        cand["probability"].alias("probability"),
        (F.col("parent_cum") + _neglog(cand["probability"])).alias("cumulative_score"),
        eos.alias("is_terminal"),
        (~eos).alias("growing"))
    base = stored(base.withColumn("growing", F.col("growing") & ~word), "base", "zstd")
    done_parts = [base.filter(~F.col("growing"))]
    growing = base.filter(F.col("growing"))
    for _ in range(p.max_subtokens - 1):
        # each round is materialised once: the union below re-reads it
        if growing.isEmpty():
            break
        rest = rank_with_backoff(growing, tri, bi, F.size("added"), p).withColumn("best", F.element_at(F.col("ranked"), 1))
        rest = with_piece(rest.drop("ranked"), "best", tri, bi)
        best = F.col("best")
        stop = best.isNull() | (best["w3"] == K.EOS_ID)
        step = rest.select(
            "prompt_id", "parent_id", "depth", "choice_rank", "parent_score", "token_id",
            F.when(stop, F.col("ctx")).otherwise(F.concat("ctx", F.array(_tok(best)))).alias("ctx"),
            F.when(stop, F.col("gen")).otherwise(F.concat("gen", F.array(best["piece"]))).alias("gen"),
            F.when(stop, F.col("added")).otherwise(F.concat("added", F.array(best["piece"]))).alias("added"),
            # the reported count is the last looked-up one, even an EOS not appended
            F.when(best.isNull(), F.col("count")).otherwise(best["cnt"].cast("double")).alias("count"),
            F.when(stop, F.col("probability")).otherwise(F.col("probability") * best["probability"]).alias("probability"),
            F.when(stop, F.col("cumulative_score"))
            .otherwise(F.col("cumulative_score") + _neglog(best["probability"])).alias("cumulative_score"),
            "is_terminal", (~stop).alias("growing"))
        step = stored(step.withColumn("growing", F.col("growing") & ~word), "grown", "zstd")
        done_parts.append(step.filter(~F.col("growing")))
        growing = step.filter(F.col("growing"))
    done_parts.append(growing)
    out = done_parts[0]
    for part in done_parts[1:]:
        out = out.unionByName(part)
    piece = F.when(F.col("is_terminal"), F.lit(K.EOS_PIECE)).otherwise(
        T.strip_symbols(decode_pieces(F.col("added"), tokenizer)))
    return out.withColumn("piece", piece).drop("added", "growing")


def expand_tree(prompts: DataFrame, tri, bi, p: TreeParams | None = None,
                tokenizer: str = "word") -> DataFrame:
    """All nodes of every prompt's tree (columns ``NODE_COLS``).

    ``prompts`` carries ``prompt_id``, ``prompt``, ``ctx`` and ``pids_tok``
    (see ``encode_prompts``); ``tri``/``bi`` are follower tables keyed by
    ``(w1, w2)`` / ``w1`` holding at least ``top_k`` eligible followers, or
    ``CountedModel``s."""
    p = p or TreeParams()
    pieces = F.transform("pids_tok", lambda x: x["piece"])
    slim_ctx = F.transform("ctx", lambda x: F.struct(x["id"].alias("id"), x["cacheable"].alias("cacheable")))
    root_text = F.when(F.size("pids_tok") > 0, T.strip_symbols(decode_pieces(pieces, tokenizer))) \
        .otherwise(T.strip_symbols(F.col("prompt")))
    # Levels are stored as columns, compressed: a node's context and texts repeat its prompt's.
    root = stored(prompts.repartition(even_parts(prompts.sparkSession)).select(
        "prompt_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"),
        F.lit(0).alias("depth"), F.lit(0).alias("choice_rank"), F.lit(None).cast("int").alias("token_id"),
        F.lit(K.TREE_ROOT_PIECE).alias("piece"), F.lit(0.0).alias("count"), F.lit(1.0).alias("score"),
        F.lit(1.0).alias("probability"), F.lit(0.0).alias("cumulative_score"), root_text.alias("text"),
        F.lit(False).alias("is_terminal"), slim_ctx.alias("ctx"), pieces.alias("gen")), "level", "zstd")
    levels, parts = [root], even_parts(prompts.sparkSession)
    frontier = root
    seen = root.select("prompt_id", F.lit(1).cast("bigint").alias("n_before"))
    for depth in range(1, p.max_depth + 1):
        ranked = rank_with_backoff(frontier, tri, bi, F.col("depth"), p).filter(F.col("ranked").isNotNull())
        children = ranked.select(
            "prompt_id", F.col("node_id").alias("parent_id"), F.lit(depth).alias("depth"),
            F.col("score").alias("parent_score"), F.col("cumulative_score").alias("parent_cum"),
            "ctx", "gen", F.posexplode(F.slice("ranked", 1, p.branch_factor)).alias("r0", "cand")
        ).withColumn("choice_rank", (F.col("r0") + 1).cast("int")).drop("r0")
        grown = grow_words(children, tri, bi, p, tokenizer)
        w = Window.partitionBy("prompt_id").orderBy("parent_id", "choice_rank")
        # Ranking is work in the row: many even tasks, and a prompt's level in one.
        level = (grown.repartition(parts, "prompt_id").join(seen.repartition(parts, "prompt_id"), "prompt_id")
                 .withColumn("node_id", (F.col("n_before") + F.row_number().over(w) - 1).cast("int"))
                 .withColumn("score", F.col("parent_score") * F.col("probability"))
                 .withColumn("text", T.strip_symbols(decode_pieces(F.col("gen"), tokenizer)))
                 .select(*NODE_COLS))
        level = stored(level, "level", "zstd")
        levels.append(level)
        frontier = level.filter(~F.col("is_terminal"))
        if frontier.isEmpty():
            break
        added = level.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"))
        seen = stored(seen.join(added, "prompt_id", "left").select(
            "prompt_id", (F.col("n_before") + F.coalesce("_n", F.lit(0))).alias("n_before")), "seen", "zstd")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def csv_tokens(nodes: DataFrame) -> DataFrame:
    """A11 rows: ``(prompt_id, node_id, token)``; the root row holds the root
    text, other rows the piece without boundary marks and symbols (``EOS``
    for an end node, since that survives symbol removal)."""
    tok = F.when(F.col("token_id").isNull(), F.lit("")).otherwise(T.clean_piece(F.col("piece")))
    tok = F.when(F.col("is_terminal") & (F.length(tok) == 0), F.lit(K.EOS_PIECE)).otherwise(tok)
    return nodes.select("prompt_id", "node_id",
                        F.when(F.col("parent_id").isNull(), F.col("text")).otherwise(tok).alias("token"))


def write_tree_csv(nodes: DataFrame, path: str) -> None:
    """One CSV per prompt (``prompt_id=<id>/``), header ``token``, rows
    in node-id order; inner quotes are doubled."""
    (csv_tokens(nodes).repartition("prompt_id").sortWithinPartitions("prompt_id", "node_id")
     .select("prompt_id", "token")
     .write.mode("overwrite").partitionBy("prompt_id")
     .option("header", True).option("escape", '"').csv(path))


def bucket_of(prompt_id, buckets: int = K.TREE_CSV_BUCKETS) -> Column:
    """Bucket of a prompt, from md5 (any store can compute it)."""
    return F.conv(F.substring(F.md5(prompt_id.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def write_tree_buckets(nodes: DataFrame, path: str, buckets: int = K.TREE_CSV_BUCKETS) -> None:
    """A11 for many prompts: at most ``buckets`` folders (``bucket=<n>/``), however
    many prompts; columns ``prompt_id, node_id, token`` in that order.
    A bucket is dealt by prompt to a few tasks, so no task gets a whole one and
    a folder gets a few files and not one from every task."""
    rows = csv_tokens(nodes).withColumn("bucket", bucket_of(F.col("prompt_id"), buckets))
    (rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("prompt_id"), F.lit(WRITERS_PER_SHARD))).sortWithinPartitions("bucket", "prompt_id", "node_id")
     .write.mode("overwrite").partitionBy("bucket").option("header", True).option("escape", '"').csv(path))


def read_tree_buckets(spark, path: str, id_type: str = "string") -> DataFrame:
    """``(prompt_id, node_id, token, bucket)`` of a folder of buckets."""
    return (spark.read.schema(f"prompt_id {id_type}, node_id int, token string, bucket long")
            .option("header", True).option("escape", '"').option("multiLine", True).csv(path))


def summary_of_buckets(rows: DataFrame, model_type: str, output_csv: str) -> DataFrame:
    """A12 from the written rows: one JSON summary per prompt."""
    cnt = rows.groupBy("prompt_id", "bucket").agg(F.count(F.lit(1)).alias("node_count"))
    return cnt.select("prompt_id", F.to_json(F.struct(
        F.lit(model_type).alias("model_type"),
        F.concat(F.lit(output_csv.rstrip("/") + "/bucket="), F.col("bucket").cast("string")).alias("output_csv"),
        "node_count")).alias("json"))


def tree_summary(nodes: DataFrame, model_type: str, output_csv: str) -> DataFrame:
    """``{"model_type", "output_csv", "node_count"}`` per prompt."""
    cnt = nodes.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("node_count"))
    return cnt.select("prompt_id", F.to_json(F.struct(
        F.lit(model_type).alias("model_type"),
        F.concat(F.lit(output_csv.rstrip("/") + "/prompt_id="), F.col("prompt_id").cast("string")).alias("output_csv"),
        "node_count")).alias("json"))
