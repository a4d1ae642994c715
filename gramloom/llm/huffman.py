"""Operator 5, token-id output: canonical length-limited Huffman coding.

**Write.**  Documents are tokenised where they lie; the same tasks count
their ids, so the stored ids are not read once more for it.  Counts of all
ids (at most one row per vocabulary entry) give a canonical Huffman code of
at most ``MAX_BITS`` bits (package-merge).  Documents are sorted by id over
the cluster, into as many files as keep a file near ``FILE_BYTES``.  Totals
give global starts.

**File format** (little endian).  ``b"HUFTOK2\\n"``; u32 header length; JSON
header with ``block`` (ids per block) and ``lengths`` (zlib of one code
length byte per id, base 64); then sections, each for about ``SECTION`` ids
of whole documents or parts of a long one: u32 ids, u32 blocks, u32 payload
bytes, u32 documents that end here, u32 bytes of their keys; u64 bit offset of
every block (the checkpoints); u32 positions behind the end ids, the document
borders; the keys (zlib of one null flag byte each, then i64 differences of
the document ids); the payload bits, most significant first.  Every block
starts at its checkpoint and can be decoded alone.

**Read.**  A file is read in splits of about ``SPLIT`` ids that start at a
section where no document is open; the manifest has one row per split: file,
byte offset, sections, ids before it.  Document ids and tokens come from the
file.  Blocks are independent, so the decoder steps through all blocks of a
section at once: the next ``MAX_BITS`` bits of each index one table that
holds id and length.

A task that is run again writes a file of another name; the manifest, stored
with the task's result, names the one that counts.

Defined cases: null text is empty (its end id alone); null ids come first;
rows of equal ids are documents of their own, ordered by text hash and text;
an empty table gives no file; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import scratch_path, ship_package, spread, stored, text_or_empty
from gramloom.llm.tokens import default_tokenizer, encoder

MAGIC = b"HUFTOK2\n"
END_ID = 1
MAX_BITS = 16
BLOCK = 256
SECTION = 1 << 20
# Ids read by one task at least, and bytes of ids (before coding) of a file.
SPLIT = 4 << 20
FILE_BYTES = 256 << 20
SLICE = 256


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits (package-merge)."""
    if not counts:
        return {}
    if len(counts) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    coins = sorted((n, s) for s, n in counts.items())
    # One level's packages: (weight, left, right), shared, never expanded.
    level: list = [(n, s) for n, s in coins]
    for _ in range(limit - 1):
        pairs = [(level[k][0] + level[k + 1][0], level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
        level = list(heapq.merge(coins, pairs, key=lambda x: x[0]))
    depth = dict.fromkeys(counts, 0)
    stack = level[:2 * len(counts) - 2]
    while stack:
        x = stack.pop()
        if len(x) == 2:
            depth[x[1]] += 1
        else:
            stack += x[1:]
    return depth


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of every symbol from its length (0: no code)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - last
            codes[s], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every ``limit`` next bits: the symbol and its code's length."""
    codes = canonical(lengths)
    order = [s for s in np.lexsort((codes, lengths)) if lengths[s]]
    sym, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    for s in order:
        n = int(lengths[s])
        at = int(codes[s]) << (limit - n)
        sym[at:at + (1 << (limit - n))] = s
        size[at:at + (1 << (limit - n))] = n
    return sym, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int) -> tuple[np.ndarray, bytes]:
    """Checkpoints (bit offset of every block) and payload of ``ids``."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    word, shift = starts >> 5, starts & 31
    # A code of at most 32 bits lies in the 64 bits from its word on; codes of one word don't overlap, so they add up.
    value = codes[ids].astype(np.uint64) << (64 - shift - n).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    if len(first):
        joint = np.bitwise_or.reduceat(value, first)
        words[word[first]] |= joint >> np.uint64(32)
        words[word[first] + 1] |= joint & np.uint64(0xFFFFFFFF)
    payload = words.astype(">u4").tobytes()[:(total + 7) // 8]
    return starts[::block].astype("<u8"), payload


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n_ids: int, block: int, sym: np.ndarray, size: np.ndarray,
                limit: int = MAX_BITS) -> np.ndarray:
    """The ids of a section; all blocks advance together."""
    blocks = len(checkpoints)
    out = np.zeros((blocks, block), np.uint32)
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8)
    at = checkpoints.astype(np.int64)
    full, left = blocks, n_ids - (blocks - 1) * block
    for k in range(block):
        if k == left:
            full = blocks - 1
            at = at[:full]
            if not full:
                break
        byte = at >> 3
        bits = ((raw[byte].astype(np.uint32) << 16) | (raw[byte + 1].astype(np.uint32) << 8) | raw[byte + 2])
        index = (bits >> (24 - limit - (at & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[:full, k] = sym[index]
        at = at + size[index]
    return out.ravel()[:n_ids]


def _open(path: str, mode: str):
    """A file on the storage that the URI names."""
    from pyarrow import fs
    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "w":
        store.create_dir(name.rpartition("/")[0])
        return store.open_output_stream(name, compression=None)
    return store.open_input_file(name)


def _uri(path: str) -> str:
    """``file:/x`` as Hadoop writes it, as the URI ``file:///x``."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _tokenise(path: str, end_id: int, size: int):
    """Ids of every document; a task's last row, without a document, holds
    its counts of all ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        seen, names = np.zeros(size, np.int64), ["doc_id", "tie", "ids", "counts"]
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                some = b.slice(lo, SLICE)
                ids = enc.encode(some.column(1).to_pylist(), end)
                seen += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=size)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(ids, pa.binary()),
                                                  pa.nulls(len(ids), pa.binary())], names=names)
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())),
                 pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], names=names)
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per id of the counts of some tasks."""
    for b in batches:
        seen = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in b.column(0).to_pylist())
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.asarray(seen)[ids], pa.int64())], names=["id", "n"])


def _pack_keys(docs: list[int | None]) -> bytes:
    null = np.array([d is None for d in docs], np.uint8)
    ids = np.array([0 if d is None else d for d in docs], "<i8")
    return zlib.compress(null.tobytes() + np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes(), 1)


def _unpack_keys(raw: bytes, n: int) -> list[int | None]:
    raw = zlib.decompress(raw)
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, n)).tolist()
    return [None if raw[k] else d for k, d in enumerate(ids)]


def _write(folder: str, lengths_z: bytes, wide: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(zlib.decompress(lengths_z), np.uint8)
        codes = canonical(lengths)
        ctx = TaskContext.get()
        name = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.huf"
        out, at, splits = None, 0, []  # splits: [offset, sections, ids]
        held: list[np.ndarray] = []
        borders: list[int] = []
        keys: list[int | None] = []
        size, whole = 0, True  # whole: no document is open where the next section starts

        def flush():
            nonlocal at, held, borders, keys, size, whole
            ids = np.concatenate(held)
            marks, payload = pack_bits(ids, codes, lengths, block)
            packed = _pack_keys(keys)
            raw = (np.array([len(ids), len(marks), len(payload), len(borders), len(packed)], "<u4").tobytes()
                   + marks.tobytes() + np.array(borders, "<u4").tobytes() + packed + payload)
            out.write(raw)
            if whole and (not splits or splits[-1][2] >= SPLIT):
                splits.append([at, 0, 0])
            splits[-1][1] += 1
            splits[-1][2] += len(ids)
            at += len(raw)
            whole = bool(borders) and borders[-1] == size
            held, borders, keys, size = [], [], [], 0

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    out = _open(name, "w")
                    head = json.dumps({"block": block, "lengths": base64.b64encode(lengths_z).decode()}).encode()
                    out.write(MAGIC + np.array([len(head)], "<u4").tobytes() + head)
                    at = len(MAGIC) + 4 + len(head)
                ids = np.frombuffer(data, f"<u{wide}")
                for lo in range(0, len(ids), SECTION):
                    part = ids[lo:lo + SECTION]
                    held.append(part)
                    size += len(part)
                    if lo + SECTION >= len(ids):
                        borders.append(size)
                        keys.append(doc)
                    if size >= SECTION:
                        flush()
        if out is not None:
            if size:
                flush()
            out.close()
            n = len(splits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ctx.partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([name] * n),
                 *(pa.array([s[k] for s in splits], pa.int64()) for k in range(3))],
                names=["part", "split", "file", "offset", "sections", "n_ids"])
    return run


def read_file(path: str, offset: int | None = None, sections: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(document id, ids)`` of every document of one file, or of the
    ``sections`` sections at ``offset``."""
    with _open(path, "r") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        head = json.loads(f.read(int(np.frombuffer(f.read(4), "<u4")[0])))
        sym, size = decode_table(np.frombuffer(zlib.decompress(base64.b64decode(head["lengths"])), np.uint8))
        if offset is not None:
            f.seek(offset)
        open_: list[np.ndarray] = []
        while (sections is None or sections > 0) and (top := f.read(20)):
            sections = None if sections is None else sections - 1
            n, blocks, n_payload, n_borders, n_keys = (int(x) for x in np.frombuffer(top, "<u4"))
            marks = np.frombuffer(f.read(8 * blocks), "<u8")
            borders = np.frombuffer(f.read(4 * n_borders), "<u4").astype(np.int64)
            keys = _unpack_keys(f.read(n_keys), n_borders)
            ids = unpack_bits(f.read(n_payload), marks, n, head["block"], sym, size)
            lo = 0
            for doc, hi in zip(keys, borders.tolist()):
                yield doc, np.concatenate([*open_, ids[lo:hi]]) if open_ else ids[lo:hi]
                open_, lo = [], hi
            if lo < n:
                open_.append(ids[lo:])


def _read(with_ids: bool):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, offset, sections, at in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows = []
                for doc, ids in read_file(name, offset, sections):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    at += len(ids)
                    if len(rows) == 1024:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)
    return run


def write_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None,
              block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; the stored manifest
    ``(part, split, file, offset, sections, n_ids, base)``, a row per split:
    ``base`` ids precede it."""
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or default_tokenizer()
    enc = encoder(path)
    wide = enc.dtype.itemsize
    size = max(enc.tok.get_vocab_size(), end_id + 1)
    text = text_or_empty(text_col)
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("tie")))
    table = stored(rows.mapInArrow(_tokenise(path, end_id, size), "doc_id long, tie long, ids binary, counts binary"),
                   "ids", "zstd")
    counts = (table.filter("counts is not null").select("counts").mapInArrow(_counts, "id int, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).collect())  # at most one row per vocabulary entry
    lengths = np.zeros(size, np.uint8)
    for s, n in code_lengths({r["id"]: r["n"] for r in counts}).items():
        lengths[s] = n
    out = _uri(folder or scratch_path(spark, "huffman"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wide * sum(r["n"] for r in counts) // FILE_BYTES))
    # Rows with equal ids and texts are alike, so their order doesn't show.
    manifest = stored(table.filter("counts is null").select("doc_id", "tie", "ids")
                      .repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie")
                      .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids").select("doc_id", "ids")
                      .mapInArrow(_write(out, zlib.compress(lengths.tobytes(), 9), wide, block),
                                  "part int, split int, file string, offset long, sections long, n_ids long"), "manifest")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(  # one row per file
        "part", before(Window.orderBy("part")).alias("file_base"))
    return (manifest.withColumn("in_file", before(Window.partitionBy("part").orderBy("split")))
            .join(F.broadcast(bases), "part").withColumn("base", F.col("file_base") + F.col("in_file"))
            .drop("file_base", "in_file"))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document,
    decoded from the files."""
    ship_package(manifest.sparkSession)
    splits = manifest.select("file", "offset", "sections", "base")
    parts = max(1, splits.count())
    return splits.repartition(parts).mapInArrow(
        _read(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
