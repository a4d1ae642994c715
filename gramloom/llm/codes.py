"""Operator 13, vector code compression: active-entry Lloyd.

A vector of integers ``floor(scale * x)`` is cut into equal parts; the code
of a part is the index of its nearest codebook entry.  Codebooks start as the
parts of the first rows by id and are refined by ``rounds`` of Lloyd's method
in integer arithmetic, so the result doesn't depend on partitions or order.

**State.**  Every round writes one table: vector, assigned entry and exact
squared distance of each part.  The next round reads it.  A part whose entry
did not move has, among the entries that stayed, still the same nearest one,
so it is compared only with the *moved* entries against its stored distance;
a part whose entry moved is scanned over the whole codebook.  Ties go to the
lower index both ways.

**Update.**  Each task adds up its parts by (part, entry); Spark sums these
rows.  Only codebooks (``parts * entries`` rows) meet the driver.

Defined cases: rows whose vector is null or holds a null or non-finite
component are dropped; a null id is kept and comes last among the starting
rows; rows of equal ids are ordered by vector, and each is a row of its own;
with fewer rows than ``entries`` the codebook has that many entries; an empty
table gives no row; extra columns are ignored.  Vectors of different lengths,
or of a length that ``parts`` doesn't divide, raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import ship_package, spread, stored
from gramloom.llm.vectors import from_bytes, integer_matrix, products, to_bytes, valid_vectors
from gramloom.session import BROADCAST_ROW_LIMIT

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Distances held at once: rows of a slice times entries.
CELLS = 1 << 22
# Rows of the label table each hot label is spread over when labels are too many to broadcast.
LABEL_SALT = 32


@dataclass
class Codebooks:
    """``entries[part, entry]`` is an integer vector; ``moved[part, entry]``
    tells whether the last update changed it."""
    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        """sha256 of all components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of the nearest entry of every row;
    ties go to the lower index."""
    at, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (entries * entries).sum(1)
    step = max(1, CELLS // max(1, len(entries)))
    for lo in range(0, len(x), step):
        some = x[lo:lo + step]
        d = norms - 2 * products(some, entries)
        best = d.argmin(1)
        at[lo:lo + step] = best
        dist[lo:lo + step] = d[np.arange(len(some)), best] + (some * some).sum(1)
    return at, dist


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, at: np.ndarray,
             dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`nearest`, from the last assignment (``at``,
    ``dist``) under entries of which only ``moved`` have changed since."""
    at, dist = at.copy(), dist.copy()
    active = moved[at]
    if active.any():
        at[active], dist[active] = nearest(x[active], entries)
    ids, still = np.flatnonzero(moved), np.flatnonzero(~active)
    if len(ids) and len(still):
        k, d = nearest(x[still], entries[ids])
        k = ids[k]
        win = (d < dist[still]) | ((d == dist[still]) & (k < at[still]))
        at[still[win]], dist[still[win]] = k[win], d[win]
    return at, dist


def _assign(books: Codebooks, scale: int, first: bool, last: bool):
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if first:
                x = integer_matrix(b.column(2), scale)
                if x.shape[1] != parts * width:
                    raise ValueError("vectors of different lengths")
            else:
                x = from_bytes(b.column(2).to_pylist(), parts * width)
                old = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4").reshape(-1, parts).astype(np.int64)
                was = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i8").reshape(-1, parts)
            at, dist = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
            for p in range(parts):
                part = x[:, p * width:(p + 1) * width]
                if first:
                    at[:, p], dist[:, p] = nearest(part, books.entries[p])
                else:
                    at[:, p], dist[:, p] = reassign(part, books.entries[p], books.moved[p], old[:, p], was[:, p])
            if last:
                cols = [pa.array(["".join(f"{k:02x}" for k in row) for row in at.tolist()]), pa.array(dist.sum(1))]
            else:
                cols = [pa.array(to_bytes(x), pa.binary()), pa.array(to_bytes(at), pa.binary()),
                        pa.array([r.tobytes() for r in dist.astype("<i8")], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols],
                                             names=["vec_id", "label", *(["code", "error"] if last else ["x", "at", "dist"])])
    return run


def _sums(parts: int, entries: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = from_bytes(b.column(0).to_pylist(), parts * width)
            at = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, parts)
            for p in range(parts):
                np.add.at(n[p], at[:, p], 1)
                np.add.at(s[p], at[:, p], x[:, p * width:(p + 1) * width])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]),
             pa.array(s[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])
    return run


def start_books(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks of the first ``entries`` rows by id (null ids last); None
    for an empty table.

    The ids alone tell where to cut, so whole vectors are sorted only among
    the rows up to that id."""
    order = F.col("vec_id").asc_nulls_last()
    ids = rows.select("vec_id").orderBy(order).limit(entries).collect()
    if not ids:
        return None
    if len(ids) == entries and ids[-1][0] is not None:
        rows = rows.filter(F.col("vec_id") <= ids[-1][0])
    top = rows.orderBy(order, "v").limit(entries).select("v").collect()
    x = integer_matrix(pa.array([r["v"] for r in top], pa.list_(pa.float64())), scale)
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
    books = x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()
    return Codebooks(books, np.ones(books.shape[:2], bool))


def updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floored means of their parts; entries that no
    part uses stay."""
    parts, entries, width = books.entries.shape
    sums = (state.select("x", "at").mapInArrow(_sums(parts, entries, width), "part int, entry int, n long, s array<long>")
            .groupBy("part", "entry").agg(F.sum("n").alias("n"),
                                          F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s")))
    new = books.entries.copy()
    for r in sums.collect():  # at most parts * entries rows
        new[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return Codebooks(new, (new != books.entries).any(2))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors and the final codebooks: a stored table
    ``(vec_id, label, code, error)``, ``code`` as two hex digits per part."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = df.sparkSession
    ship_package(spark)
    rows = spread(valid_vectors(df, vec_col, F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                F.col(f"`{label_col}`").alias("label")))
    label = df.schema[label_col].dataType.simpleString()
    result = f"vec_id long, label {label}, code string, error long"
    books = start_books(rows, parts, entries, scale)
    if books is None:
        return spark.createDataFrame([], result), None
    state = rows
    for turn in range(rounds):
        state = stored(state.mapInArrow(_assign(books, scale, turn == 0, False),
                                        f"vec_id long, label {label}, x binary, at binary, dist binary"), "lloyd")
        books = updated(state, books)
    return stored(state.mapInArrow(_assign(books, scale, rounds == 0, True), result), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over the rows of a label (nulls
    are one label).

    The sums meet their rows by a broadcast if the counted labels are few;
    else by a join in which every label is spread over salted copies."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    a, b = codes.alias("a"), sums.alias("b")
    same = F.col("a.label").eqNullSafe(F.col("b.label"))
    if sums.count() <= BROADCAST_ROW_LIMIT:
        return a.join(F.broadcast(b), same).select("a.*", "label_error")
    a = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALT)).cast("int")).alias("a")
    b = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALT - 1)))).alias("b")
    return a.join(b, same & (F.col("a.salt") == F.col("b.salt"))).select("a.*", "label_error").drop("salt")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by full scans in DuckDB SQL (vectors of 64 components)."""
    width = 64 // parts
    x = f"list_transform(embedding, lambda c: floor({scale} * c::DOUBLE))"
    cut = " UNION ALL ".join(
        f"SELECT rid, vec_id, {p} AS part, x[{p * width + 1}:{(p + 1) * width}] AS v FROM kept" for p in range(parts))
    out = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, {x} AS x
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS vv FROM ({cut})),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v AS e FROM p WHERE rid <= {entries})"""]
    for t in range(rounds + 1):
        out.append(f"""a{t} AS MATERIALIZED (SELECT rid, p.part, min(struct_pack(d := vv - 2 * list_inner_product(v, e)
    + list_inner_product(e, e), k := entry)) AS best FROM p JOIN b{t} ON p.part = b{t}.part GROUP BY ALL)""")
        if t < rounds:
            out.append(f"""m{t} AS (SELECT part, best.k AS entry, i, floor(sum(v[i]) / count(*)) AS c
  FROM a{t} JOIN p USING (rid, part), generate_series(1, {width}) g(i) GROUP BY ALL),
b{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.e, b{t}.e) AS e FROM b{t}
  LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS e FROM m{t} GROUP BY ALL) n USING (part, entry))""")
    final = f"a{rounds}"
    return "WITH " + ",\n".join(out) + f""",
books AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS h
  FROM b{rounds}),
r AS (SELECT rid, string_agg(lower(lpad(to_hex(best.k::BIGINT), 2, '0')), '' ORDER BY part) AS code,
  sum(best.d)::BIGINT AS error FROM {final} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM r JOIN kept USING (rid), books"""
