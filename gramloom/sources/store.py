"""Storing and loading models.

Models are parquet tables; a sharded model is partitioned on disk by the
context hash (``shard=<i>`` directories) with a one-row JSON manifest, so a
lookup reads only the shards its contexts hash to (partition pruning, static
or dynamic).  Writes go to shared storage (paths given by the caller, or
under the session's checkpoint directory for scratch output)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gramloom import constants as K
from gramloom.functions.arrays import shard_of
from gramloom.session import ensure_checkpoint_dir

MANIFEST = "_manifest"
WRITERS_PER_SHARD = 4


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gramloom-out/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it
    back: the lineage is cut and a lost executor costs no recomputation of
    what came before.  Columns and compression keep it far smaller than a
    checkpoint of the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_present(spark: SparkSession, path: str) -> bool:
    """Exists and is not empty (a zero-byte file counts as absent)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return fs.getContentSummary(p).getLength() > 0


def write_bigram(bigram: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3."""
    bigram.write.mode(mode).parquet(path)


def write_partial(parts: DataFrame, path: str) -> None:
    """A4: partial counts by ``part_id``; re-running a chunk replaces only
    that chunk's folder (dynamic partition overwrite)."""
    (parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part_id").parquet(path))


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """A4: the stored partial counts; raises if there are none, since merging
    nothing would leave an empty model behind."""
    if not path_present(spark, path):
        raise FileNotFoundError(f"no partial counts under {path}")
    return spark.read.parquet(path)


def write_trigram(model: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: clustered by context so readers find a context's rows together."""
    (model.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "w3")
     .write.mode(mode).parquet(path))


def duplicate_keys(model: DataFrame, keys=("w1", "w2", "w3")) -> DataFrame:
    """A6 primary-key check: keys that occur more than once (empty = OK)."""
    return model.groupBy(*keys).count().filter(F.col("count") > 1)


def export_counts_table(model: DataFrame, name: str, path: str | None = None) -> None:
    """Replace the flat ``(w1, w2, w3, cnt)`` table (its files in
    ``path``, default the warehouse); raises if a key occurs twice, and the
    old table stays.

    The rows are counted by key in the job that writes them, which moves
    nothing where the model lies by its keys.  They are written beside the old
    table (in ``path``, if that is free) and take its place behind the check."""
    keys, spark = ["w1", "w2", "w3"], model.sparkSession
    flat = model.select(*[F.col(k).cast("int") for k in keys], F.col("cnt").cast("bigint"))
    most = Observation()
    counted = flat.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    placed = path if path and not path_present(spark, path) else scratch_path(spark, "export")
    (counted.observe(most, F.max("_n").alias("most")).drop("_n")  # the largest: a task that runs again changes nothing
     .write.mode("overwrite").parquet(placed, compression="zstd"))
    if (most.get["most"] or 0) > 1:
        raise ValueError("the model has a (w1, w2, w3) key more than once")
    if placed == path:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path, "parquet", flat.schema)
        return
    writer = spark.read.schema(flat.schema).parquet(placed).write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_sharded(model: DataFrame, path: str, num_shards: int = K.DEFAULT_NUM_SHARDS,
                  mode: str = "overwrite") -> None:
    """A7 + A8: ``shard=<i>`` folders and a manifest that records the
    requested shard count (also when some shards are empty).  ``mode``
    ``overwrite`` resets the output, ``append`` keeps it."""
    spark = model.sparkSession
    sharded = model.withColumn("shard", shard_of(F.col("w1"), F.col("w2"), num_shards))
    # A shard's rows meet in a few tasks, so a folder gets a few files and not one from every task.
    (sharded.repartition(F.col("shard"), F.pmod(F.xxhash64("w1", "w2"), F.lit(WRITERS_PER_SHARD)))
     .sortWithinPartitions("shard", "w1", "w2", "w3")
     .write.mode(mode).partitionBy("shard").parquet(path))
    manifest = spark.createDataFrame(
        [(K.SHARD_FORMAT, num_shards, [f"shard={i}" for i in range(num_shards)])],
        "format string, num_shards int, shards array<string>")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> int:
    """Requested shard count from the manifest (one small row)."""
    row = spark.read.json(f"{path}/{MANIFEST}").first()
    if row is None or row["format"] != K.SHARD_FORMAT:
        raise ValueError(f"no sharded model manifest under {path}")
    return int(row["num_shards"])


def read_sharded(spark: SparkSession, path: str, contexts: DataFrame | None = None) -> DataFrame:
    """The sharded model; with ``contexts`` (columns w1, w2) only the
    matching rows, from the shard folders that some context hashes to (their
    numbers, at most the shard count, are found first)."""
    n = read_manifest(spark, path)
    model = spark.read.parquet(path)
    if contexts is None:
        return model.drop("shard")
    ctx = contexts.withColumn("shard", shard_of(F.col("w1"), F.col("w2"), n))
    asked = [r["shard"] for r in ctx.select("shard").distinct().collect()]
    return ctx.join(model.filter(F.col("shard").isin(asked)), ["shard", "w1", "w2"]).drop("shard")


def load_model(spark: SparkSession, base: str, table: str | None = None) -> tuple[DataFrame, str]:
    """A10: the best available model, in this order: flat table, sharded
    model, single trigram model; partials only -> error; else bigram; no
    model at all -> error."""
    if table and spark.catalog.tableExists(table):
        return spark.table(table), "table_trigram"
    if path_present(spark, f"{base}/trigram_shards/{MANIFEST}"):
        read_manifest(spark, f"{base}/trigram_shards")
        return spark.read.parquet(f"{base}/trigram_shards").drop("shard"), "sharded_trigram"
    if path_present(spark, f"{base}/trigram"):
        return spark.read.parquet(f"{base}/trigram"), "trigram"
    if path_present(spark, f"{base}/trigram_parts"):
        raise FileNotFoundError("only partial trigram counts exist: merge them into shards first")
    if not path_present(spark, f"{base}/bigram"):
        raise FileNotFoundError(f"no trigram and no bigram model under {base}")
    return spark.read.parquet(f"{base}/bigram"), "bigram"


def bucketed(rows: DataFrame, keys: list[str], folder: str, buckets: int | None = None, name: str | None = None,
             hint: str = "merge") -> DataFrame:
    """Store a table in buckets of ``keys``, sorted inside, and read it back:
    joins on ``keys`` then shuffle only the other side.  The table lies in the
    shared scratch folder; ``name`` makes it known to the catalog (default: a
    fresh one)."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"{folder}_{uuid.uuid4().hex[:12]}"
    (rows.repartition(n, *keys).write.mode("overwrite").option("path", scratch_path(spark, folder))
     .option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name).hint(hint) if hint else spark.table(name)


def bucketed_followers(followers: DataFrame, keys: list[str], buckets: int | None = None, name: str | None = None) -> DataFrame:
    """A follower table in buckets of its context (:func:`bucketed`)."""
    return bucketed(followers, keys, "followers", buckets, name)


def generation_json(results: DataFrame) -> DataFrame:
    """``{"text", "model_type"}`` per prompt (non-ASCII kept as is)."""
    return results.select("prompt_id", F.to_json(F.struct("text", "model_type")).alias("json"))
