"""Corpus lines.

A corpus is a table of documents; each document's text is a sequence of
lines (universal newlines), exactly as if the texts were written one after
another into a line-oriented file.  Lines keep their source order through
``(doc_id, line_no)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.functions import text as T
from gramloom.session import maybe_broadcast


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows only when the scan yields fewer partitions than
    the cluster can run at once (e.g. a single-row-group file).  A corpus of
    many files already scans in parallel and is left alone (no shuffle)."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def doc_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its raw lines as an array:
    ``(doc_id, lines ARRAY<STRING>)``."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       T.split_lines(F.col(text_col)).alias("lines"))


def read_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A1: raw lines ``(doc_id, line_no, line)``; blank lines included.

    The split is exploded as an expression: for a plain array *column*
    Catalyst adds a filter on its size, which would split every text once
    more, below the exchange of :func:`spread`, in the few tasks of the scan."""
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.posexplode(T.split_lines(F.col(text_col))).alias("line_no", "line"))
            .withColumn("line_no", F.col("line_no").cast("int")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """A1 for plain text files: every line becomes a row
    ``(doc_id, line_no BIGINT, line)``; each file is one document and
    ``line_no`` is the dense line number within the file.

    A large file is split over many scan tasks.  Within a task its lines
    are contiguous with consecutive ``monotonically_increasing_id`` values,
    and its splits come in file order, so the number is the lines of the
    file in earlier tasks plus the position inside this task.  Those
    per-(file, task) counts are a small table: no file is ever sorted or
    gathered in one task."""
    raw = spark.read.text(path).select(
        F.xxhash64(F.input_file_name()).alias("doc_id"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("line"))
    stats = raw.groupBy("doc_id", "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    stats = stats.withColumn("_off", F.sum("_n").over(
        Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("_n"))
    return raw.join(stats, ["doc_id", "_part"]).select(
        "doc_id", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), "line")


def clean_lines(lines: DataFrame, normalize: bool = False, line_col: str = "line") -> DataFrame:
    """B1+B2 (and B3 when ``normalize``): strip (normalise), drop blanks."""
    expr = T.normalize_line(line_col) if normalize else T.strip(line_col)
    return lines.withColumn(line_col, expr).filter(F.length(line_col) > 0)


def valid_doc_lines(docs: DataFrame, normalize: bool = False, text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """Per document, the array of cleaned non-blank lines, in order."""
    fn = T.normalize_line if normalize else T.strip
    return (doc_lines(docs, text_col, id_col)
            .select("doc_id", F.filter(F.transform("lines", lambda x: fn(x)),
                                       lambda x: F.length(x) > 0).alias("lines")))


# ---------------------------------------------------------------------------
# Exact global positions without a single-partition window over all lines.
# ---------------------------------------------------------------------------

def _key_ranges(df: DataFrame, key: str, num_buckets: int) -> DataFrame:
    """``df`` with ``_b``, the number of its key's range (null keys come
    last).  At most ``num_buckets`` ranges are cut at approximate quantiles,
    which read the key column only."""
    probs = [i / num_buckets for i in range(1, num_buckets)]
    cuts = sorted(set(df.select(key).approxQuantile(key, probs, 0.001))) if num_buckets > 1 else []
    if not cuts:
        return df.withColumn("_b", F.lit(0))
    # JVM-side binary search over the (bounded) cut points.
    from pyspark.ml.feature import Bucketizer
    splits = [-float("inf")] + [float(c) for c in cuts] + [float("inf")]
    return (Bucketizer(splits=splits, inputCol="_kd", outputCol="_bd")
            .transform(df.withColumn("_kd", F.col(key).cast("double")))
            .withColumn("_b", F.coalesce(F.col("_bd").cast("int"), F.lit(len(splits)))).drop("_kd", "_bd"))


def key_offsets(counts: DataFrame, key: str = "doc_id", n: str = "n",
                num_buckets: int = 1024) -> DataFrame:
    """For a table with one row per ``key`` and a count ``n``, return
    ``(key, offset)`` where ``offset`` = sum of ``n`` over all smaller keys.

    Keys are cut into at most ``num_buckets`` ranges at approximate
    quantiles (balanced even if keys cluster).  Each range does its own
    running sum in parallel; the per-range totals (<= num_buckets rows, a
    proven bound) get a tiny running sum and are broadcast back."""
    kb = _key_ranges(counts.select(F.col(key).alias("_k"), F.col(n).cast("bigint").alias("_n")), "_k", num_buckets)
    within = kb.withColumn(
        "_within",
        F.sum("_n").over(Window.partitionBy("_b").orderBy("_k")
                         .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    totals = kb.groupBy("_b").agg(F.sum("_n").alias("_bn"))
    boff = totals.select("_b", (F.sum("_bn").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("_bn")).alias("_boff"))
    return (within.join(F.broadcast(boff), "_b")
            .select(F.col("_k").alias(key), (F.col("_boff") + F.col("_within")).alias("offset")))


def dense_index(df: DataFrame, order: list, name: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (of its columns ``keep``, if given) with its dense 0-based
    position in ``order``.

    The rows are sorted over the cluster and stored; a position is the rows
    of earlier partitions (one count each, broadcast) plus the place inside
    its own partition, so no task sees all rows."""
    from gramloom.sources.store import stored
    placed = stored(df.orderBy(*order).select(*(keep or df.columns), F.spark_partition_id().alias("_p"),
                                              F.monotonically_increasing_id().alias("_m")), "sorted", "zstd")
    parts = placed.groupBy("_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_p", "_first", (F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_off"))
    return (placed.join(F.broadcast(parts), "_p")
            .withColumn(name, F.col("_off") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_off"))


def _inner(lines_col: str):
    """The array as an expression, so that exploding it adds no filter that
    computes it once more (see :func:`read_lines`)."""
    return F.slice(lines_col, 1, F.size(lines_col))


def indexed_lines(per_doc: DataFrame, lines_col: str = "lines", num_buckets: int = 1024) -> DataFrame:
    """Explode ``(doc_id, lines ARRAY)`` into ``(doc_id, line_no, line, idx)``
    where ``idx`` is the dense 0-based position in (doc_id, line_no) order.

    The text is read once.  Documents go to the tasks by ranges of their
    ids, sorted; the lines are stored with their place in their task.  A
    range lies in one task, so a line's position is the lines of earlier
    ranges (at most ``num_buckets`` counts, broadcast) plus its place after
    the first line of its own range.  Ids are taken to tell documents apart:
    rows of one id share a range, in any order."""
    from gramloom.sources.store import scratch_path
    spark = per_doc.sparkSession
    ranges = _key_ranges(per_doc.select("doc_id", lines_col), "doc_id", num_buckets)
    rows = (ranges.repartition("_b").sortWithinPartitions("_b", F.asc_nulls_last("doc_id"))
            .select("doc_id", "_b", F.posexplode(_inner(lines_col)).alias("line_no", "line"))
            .withColumn("line_no", F.col("line_no").cast("int")).withColumn("_m", F.monotonically_increasing_id()))
    path = scratch_path(spark, "lines")
    rows.write.parquet(path, compression="zstd")
    placed = spark.read.schema(rows.schema).parquet(path)
    starts = placed.groupBy("_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_b", (F.sum("_n").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        - F.col("_n") - F.col("_first")).alias("_shift"))
    return (placed.join(F.broadcast(starts), "_b")
            .select("doc_id", "line_no", "line", (F.col("_m") + F.col("_shift")).alias("idx")))


def limit_lines(docs: DataFrame, max_lines: int | None, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """A2: keep the first ``max_lines`` raw lines (blank lines count) in
    source order; ``None`` keeps everything."""
    if max_lines is None:
        return read_lines(docs, text_col, id_col)
    per_doc = doc_lines(docs, text_col, id_col).filter(F.size("lines") > 0)
    # Only documents that start before the limit are read again: at most max_lines of them.
    offs = key_offsets(per_doc.select("doc_id", F.size("lines").alias("n")), "doc_id", "n").filter(
        F.col("offset") < max_lines)
    return (per_doc.join(maybe_broadcast(offs, max_lines), "doc_id")
            .select("doc_id", "offset", F.posexplode(_inner("lines")).alias("line_no", "line"))
            .filter(F.col("offset") + F.col("line_no") < max_lines)
            .select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line"))


def corpus_lines(spark: SparkSession, sf_dir: str, normalize: bool = False) -> DataFrame:
    """Cleaned lines of the ``documents`` table (the test corpus)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean_lines(read_lines(docs), normalize=normalize)
