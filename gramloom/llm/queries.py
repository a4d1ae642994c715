"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import (codes, decontaminate, html, huffman, licenses, packing, quality, search, secrets, simhash,
                          spelling, toxicity, warc)
from gramloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids."""
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False)


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_benchmark_decontamination", decontaminate.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) pair with the item in the document."""
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that starts empty."""
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


@query("op5_token_id_output")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the Huffman-coded files."""
    return huffman.read_ids(huffman.write_ids(read_table(spark, sf_dir, "documents")), with_ids=False)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and offending sentences of every document."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    manifest = warc.write_pages(read_table(spark, sf_dir, "pages"))
    return warc.read_pages(manifest, with_payload=False).drop("url")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return (html.extract(read_table(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


@query("op3_license_scans", licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted by each document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op11_exact_top_k", search.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return search.top_k(read_table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants", spelling.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling.group_variants(read_table(spark, sf_dir, "documents"))


@query("op13_vector_codes", codes.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector under the final codebooks."""
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"))
    return codes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
