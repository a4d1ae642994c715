"""Session helpers: local sessions for tests/bench, checkpoint directory,
and size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is bounded by a parameter
# (vocabulary size, number of prompts after a count, top-k) and that bound is
# under this many rows.
BROADCAST_ROW_LIMIT = 2_000_000
# A counted table of strings is broadcast only if its strings are small too.
BROADCAST_BYTE_LIMIT = 128 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gramloom", driver_memory: str = "8g") -> SparkSession:
    """A local session configured the way tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Where it is unset, a local session gets a scratch folder; a
    cluster session raises, since executors do not share the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="gramloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint to the shared checkpoint directory (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def maybe_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast ``df`` only if ``row_bound`` (a proven upper bound on its
    rows) is known and small; otherwise leave the join strategy to Catalyst
    and AQE, which will shuffle."""
    if row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def broadcast_bound(df: DataFrame, text_col: str) -> int | None:
    """Counted rows of a stored table if it may be broadcast by rows and by
    the bytes of ``text_col``, else ``None`` (the join then shuffles)."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return n if n <= BROADCAST_ROW_LIMIT and size <= BROADCAST_BYTE_LIMIT else None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gramloom`` importable in Python workers (needed by the pandas
    functions) by shipping a zip of the package with ``addPyFile``; done
    once per SparkContext."""
    import shutil
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="gramloom-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "gramloom"), "zip", root_dir=root, base_dir="gramloom")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
