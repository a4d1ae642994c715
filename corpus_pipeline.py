"""The corpus pipeline: quality rules, near-duplicates, benchmark
decontamination, secret scans, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written
as Parquet in the shared scratch folder and read again as the next stage's
``docs``.  All but the last keep the columns of ``documents``:

1. ``quality_rules`` drops documents that fail the rules or the model.
2. ``simhash_near_dedup`` leaves one document of each near-duplicate group.
3. ``benchmark_decontamination`` drops documents that contain a test item.
4. ``secret_scans`` masks secrets in the texts (documents stay).
5. ``packing`` returns the pieces of the packed sequences with their ids, and
   writes the whole sequences as a table ``sequences`` beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramloom.llm import decontaminate, packing, quality, secrets, simhash
from gramloom.llm.common import read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


# Python workers outlive their stage, and what they keep lies beside the JVM of the stages after it.
MEMO_ITEMS = 100_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, compression="zstd", memo_items=MEMO_ITEMS)
    packing.sequences(pieces, compression="zstd")
    return pieces


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# Hashing, fingerprints and the tokenizer have no SQL form; tests/llm hold
# the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
