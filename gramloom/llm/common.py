"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.session import ship_package
from gramloom.sources.lines import read_table, spread
from gramloom.sources.store import scratch_path, stored

__all__ = ["crc32_text", "fresh", "read_table", "spread", "stored", "text_or_empty", "scratch_path",
           "ship_package", "SPACE", "WORD"]

# The word rule of the contracts: maximal runs of characters other than
# these six ASCII white-space characters.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet (Spark
    compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def crc32_text(col: Column) -> Column:
    """Unsigned crc32 of the value written as text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def words_of(text: Column) -> Column:
    """Words of a text as an array: runs of non-space characters.  A text
    of white space only has none."""
    # Looking at the ends only; a pattern would be tried at every character.
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(text.rlike(WORD), F.split(trimmed, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))
