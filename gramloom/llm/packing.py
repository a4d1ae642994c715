"""Operator 1, packing: concatenate and cut.

All documents, in scan order, form one stream of token ids (each document
followed by an end id); the stream is cut into windows of ``window`` ids.

1. Each task tokenises its documents, keeps a running total and writes
   ``(part, start inside the part, n, ids)`` to a shared table.
2. The totals of the parts (one row per task) get a running sum; it turns
   starts inside a part into global starts.
3. Each document is cut at multiples of ``window`` where it lies; no id is
   shuffled.  Windows that lie in one task are complete there; only the
   pieces at task borders are boundary records, shuffled by window id.

Only the last sequence is shorter than the window.

Defined cases: a null text is empty and holds the end id alone; a null
document id is kept as null; repeated rows are documents of their own; an
empty table gives no piece.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import scratch_path, ship_package, spread, stored, text_or_empty
from gramloom.llm.tokens import MEMO_ITEMS, default_tokenizer, encoder

END_ID = 2
WINDOW = 4096
# Documents encoded in one go: bounds the memory of a batch's word lists.
SLICE = 256

TOKEN_SCHEMA = "doc_id long, part int, start_in_part long, n long, ids binary"


def _tokenise(path: str, end_id: int, memo_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, memo_items)
        end = np.array([end_id], enc.dtype).tobytes()
        part, at, wide = TaskContext.get().partitionId(), 0, enc.dtype.itemsize
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                some = b.slice(lo, SLICE)
                ids = enc.encode(some.column(1).to_pylist(), end)
                n = np.array([len(x) // wide for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n),
                     pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "start_in_part", "n", "ids"])
    return run


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text", compression: str | None = None, memo_items: int = MEMO_ITEMS) -> DataFrame:
    """Stored token ids of every document with global starts:
    ``(doc_id, start, n, ids)``.  ``memo_items`` bounds what a worker keeps
    after its tasks are done."""
    ship_package(docs.sparkSession)
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                              text_or_empty(text_col).alias("text")))
    table = stored(rows.mapInArrow(_tokenise(tokenizer or default_tokenizer(), end_id, memo_items), TOKEN_SCHEMA),
                   "tokens", compression)
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the job above.
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return (table.join(F.broadcast(bases), "part")
            .select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n", "ids"))


def _cut(window: int, wide: int, with_ids: bool):
    dtype = np.dtype(f"<u{wide}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            raw: list[bytes] = []
            for doc, start, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                           b.column(2).to_pylist(), b.column(3).to_pylist()):
                ids = np.frombuffer(data, dtype).astype("<u4").tobytes()
                at = 0
                while at < n:
                    seq, offset = divmod(start + at, window)
                    size = min(window - offset, n - at)
                    piece = ids[4 * at:4 * (at + size)]
                    for k, v in zip(cols, (doc, at, size, zlib.crc32(piece), n, seq, offset)):
                        cols[k].append(v)
                    if with_ids:
                        raw.append(piece)
                    at += size
            arrays = [pa.array(v, pa.int64()) for v in cols.values()] + ([pa.array(raw, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *(["ids"] if with_ids else [])])
    return run


def pieces(tokens: DataFrame, window: int = WINDOW, wide: int | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents of :func:`tokenised`: one row per document
    and window it touches.  ``ids`` are little-endian unsigned 32-bit."""
    if wide is None:
        wide = encoder(default_tokenizer()).dtype.itemsize
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))
    return tokens.select("doc_id", "start", "n", "ids").mapInArrow(_cut(window, wide, with_ids), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, compression: str | None = None,
         memo_items: int = MEMO_ITEMS) -> DataFrame:
    """Pack ``docs``: rows ``(doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset[, ids])``."""
    path = tokenizer or default_tokenizer()
    return pieces(tokenised(docs, path, end_id, id_col, text_col, compression, memo_items), window, encoder(path).dtype.itemsize, with_ids)


def _assemble(window: int):
    names = ["sequence_id", "offset", "ids", "whole"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for b in batches:
            done = []
            for seq, offset, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                if seq != last:  # the scan left a window: it is whole, or a boundary record
                    done += _close(last, parts, window)
                    last, parts = seq, []
                parts.append((offset, ids))
            yield batch(done)
        yield batch(_close(last, parts, window))
    return run


def _close(seq: int | None, parts: list[tuple[int, bytes]], window: int) -> list[tuple[int | None, int, bytes, bool]]:
    ids = b"".join(x for _, x in sorted(parts))
    if len(ids) == 4 * window:
        return [(seq, 0, ids, True)]
    return [(seq, at, x, False) for at, x in parts]


def sequences(packed: DataFrame, window: int = WINDOW, compression: str | None = None) -> DataFrame:
    """Whole sequences ``(sequence_id, ids binary, n_tokens)`` of the pieces
    of :func:`pack`, stored once.  Windows whose pieces lie in one task are
    written whole; boundary records lie beside them and are gathered per
    window (at most ``window`` ids) when they are read."""
    spark = packed.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "sequences")
    schema = "sequence_id long, offset long, ids binary, whole boolean"
    (packed.select("sequence_id", "offset", "ids").mapInArrow(_assemble(window), schema)
     .write.partitionBy("whole").parquet(path, compression=compression))
    rows = spark.read.schema(schema).parquet(path)
    border = (rows.filter("not whole").groupBy("sequence_id")
              .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
              .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
                      .alias("ids")))
    return (rows.filter("whole").select("sequence_id", "ids").unionByName(border)
            .withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")))
