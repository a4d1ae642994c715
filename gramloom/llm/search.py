"""Operator 11, exact top-k search by inner product: pivot-distance index.

Inner products become distances: with ``M`` the largest norm of all vectors,
a candidate ``x`` gets one more coordinate ``sqrt(M*M - |x|*|x|)`` and a
query 0; then ``dist(q, x)**2 = |q|**2 + M*M - 2 * q.x``, so the highest
scores are the smallest distances.

**Index.**  Pivots are fitted on a bounded sample; every vector is keyed by
its nearest pivot and its distance from it.  Each pivot's vectors, sorted by
distance, form annuli (approximate quantiles; their true bounds are counted).
An annulus is dealt into blocks of about ``block`` rows, one table row each,
sorted by distance inside.  The table of annuli has at most ``pivots *
rings`` rows.

**Search.**  Queries travel in groups.  A group visits annuli by ascending
lower bound ``max(r_lo - d, d - r_hi, 0)`` (triangle inequality), a few at
first, then more; after each round its ``k``-th best distances shrink, and an
annulus whose bound exceeds that of every query of the group is never read.
Inside a block only the rows whose distance from the pivot is within reach
are scored, by exact integer products.  Ties and rounding are on the safe
side: bounds get a slack, and annuli at exactly the bound are read.

Every join key is one block, so a pivot or annulus with a third of all rows
(copies) is spread evenly; a query keeps at most ``k`` rows per block, and a
window group limit keeps ``k`` per task before the shuffle.

Defined cases: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part; a repeated query row is a query of its
own; candidates are all rows of other ids, repeated rows each; with fewer than
``k`` candidates all are returned; an empty table gives no row; extra columns
are ignored.  Vectors of different lengths raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import ship_package, spread, stored
from gramloom.llm.vectors import from_bytes, integer_matrix, products, to_bytes, valid_vectors

SCALE = 256
K = 5
PIVOTS = 32
RINGS = 32
# Rows of a block and of a query group (less for very wide vectors), and bytes of either at most.
BLOCK = 1024
GROUP = 128
BLOCK_BYTES = 4 << 20
# Rows of the sample that the pivots are fitted on (about; the bound of what reaches the driver).
SAMPLE = 4096
# Annuli that a group has visited after each round (the last round visits what is left).
VISITS = (4, 64)


@dataclass
class Space:
    """What every task needs: pivots (with the added coordinate), the
    largest squared norm, vector length."""
    pivots: np.ndarray
    top: int
    dim: int

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0).astype(np.float64))
        return np.hstack([x.astype(np.float64), extra[:, None]])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distance of every row to every pivot."""
        y = self.lift(x, query)
        d = (y * y).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(d, 0))

    @property
    def slack(self) -> float:
        """More than rounding can change a distance."""
        return 1e-6 * (1 + float(self.top) ** 0.5)

    def reach(self, x: np.ndarray, worst: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Distance of each query's ``k``-th best score (infinite if it has
        fewer)."""
        d = (x * x).sum(1) + self.top - 2 * worst
        return np.where(known, np.sqrt(np.maximum(d, 0).astype(np.float64)) + self.slack, np.inf)


def fit_pivots(sample: np.ndarray, top: int, pivots: int, steps: int = 8) -> np.ndarray:
    """Centres of the lifted sample (Lloyd's method)."""
    y = Space(np.zeros((0, 0)), top, sample.shape[1]).lift(sample)
    c = np.unique(y, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(pivots, len(c))).astype(int)]
    for _ in range(steps):
        d = (c * c).sum(1) - 2 * y @ c.T
        at = d.argmin(1)
        for k in np.unique(at):
            c[k] = y[at == k].mean(0)
    return c


def _measure(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, lo, hi = 0, 0, None, None
        for b in batches:
            x = integer_matrix(b.column(0), scale)
            if len(x):
                n += len(x)
                top = max(top, int((x * x).sum(1).max()))
                lo = x.shape[1] if lo is None else min(lo, x.shape[1])
                hi = x.shape[1] if hi is None else max(hi, x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (n, top, lo, hi)],
                                         names=["n", "top", "lo", "hi"])
    return run


def _key(space: Space, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            x = integer_matrix(b.column(1), scale)
            d = space.distances(x)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(x))), b.column(0), pa.array(at, pa.int32()),
                 pa.array(d[np.arange(len(x)), at]), pa.array(to_bytes(x), pa.binary())],
                names=["row", "vec_id", "pivot", "r", "x"])
            row += len(x)
    return run


def _gather(t: pa.Table) -> pa.Table:
    """The rows of one block or query group as one row, sorted by distance."""
    t = t.sort_by([("r", "ascending"), ("row", "ascending")])
    cell = lambda v: pa.array([v], pa.binary())
    return pa.table([t["at"][:1].combine_chunks(), t["sub"][:1].combine_chunks(),
                     cell(t["vec_id"].to_numpy().astype("<i8").tobytes()),
                     cell(t["r"].to_numpy().astype("<f8").tobytes()), cell(b"".join(t["x"].to_pylist()))],
                    names=["at", "sub", "ids", "rs", "xs"])


def _dealt(rows: DataFrame, at: Column, parts: Column) -> DataFrame:
    """Rows of equal ``at`` gathered into ``parts`` rows of about equal size."""
    return (rows.select(at.alias("at"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("sub"), "row", "vec_id", "r", "x")
            .groupBy("at", "sub").applyInArrow(_gather, "at int, sub int, ids binary, rs binary, xs binary"))


def _visit(space: Space, rings: np.ndarray, lo: int, hi: int):
    """Pairs of query group and block for annuli ``lo`` to ``hi`` in the
    group's own order.  ``rings``: columns pivot, ring, blocks, r_lo, r_hi."""
    pivot = rings[:, 0].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, sub, ids, xs, kth in zip(*(b.column(k).to_pylist() for k in range(5))):
                x = from_bytes([xs], space.dim)
                worst = np.array([0 if v is None else v for v in kth], np.int64)
                reach = space.reach(x, worst, np.array([v is not None for v in kth], bool))
                d = space.distances(x, True)[:, pivot]
                bound = np.maximum(np.maximum(rings[:, 3] - d, d - rings[:, 4]), 0)
                order = np.argsort(bound.min(0), kind="stable")[lo:hi]
                order = order[(bound[:, order] <= reach[:, None]).any(0)]
                for k in range(0, len(order), 16):
                    some = order[k:k + 16]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rings[some, 1], pa.int32()), pa.array(rings[some, 2], pa.int32()),
                         pa.array(pivot[some], pa.int32()), pa.array([at] * n, pa.int32()), pa.array([sub] * n, pa.int32()),
                         pa.array([ids] * n, pa.binary()), pa.array([xs] * n, pa.binary()),
                         pa.array([kth] * n, pa.list_(pa.int64()))],
                        names=["ring", "blocks", "pivot", "g_at", "g_sub", "q_ids", "q_xs", "kth"])
    return run


def _score(space: Space, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g_at", "g_sub", "q", "query_id", "vec_id", "score"]
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for pivot, at, sub, q_ids, q_xs, kth, ids, rs, xs in zip(*(b.column(i).to_pylist() for i in range(9))):
                qx = from_bytes([q_xs], space.dim)
                worst = np.array([0 if v is None else v for v in kth], np.int64)
                known = np.array([v is not None for v in kth], bool)
                reach = space.reach(qx, worst, known)
                d, r = space.distances(qx, True)[:, pivot], np.frombuffer(rs, "<f8")
                # The part of the sorted annulus that some query can reach.
                lo = np.searchsorted(r, (d - reach).min() - space.slack, "left")
                hi = np.searchsorted(r, (d + reach).max() + space.slack, "right")
                if lo >= hi:
                    continue
                cand = np.frombuffer(ids, "<i8")[lo:hi]
                query = np.frombuffer(q_ids, "<i8")
                s = products(qx, np.frombuffer(xs, "<i4").reshape(-1, space.dim)[lo:hi].astype(np.int64))
                own = query[:, None] == cand[None, :]
                by_id = np.argsort(cand, kind="stable")
                for q in range(len(query)):
                    ok = ~own[q] & ((s[q] >= worst[q]) if known[q] else True)
                    hit = by_id[ok[by_id]]
                    if len(hit) > k:
                        hit = hit[np.argsort(-s[q][hit], kind="stable")[:k]]
                    if len(hit):
                        n = len(hit)
                        for col, v in zip(out, (np.full(n, at), np.full(n, sub), np.full(n, q), np.full(n, query[q]),
                                                cand[hit], s[q][hit])):
                            col.append(v)
            if out[0]:
                kinds = [pa.int32()] * 3 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names=names)
    return run


FOUND = "g_at int, g_sub int, q int, query_id long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(df: DataFrame, every: int = 50, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, rings: int = RINGS,
          block: int = BLOCK, group: int = GROUP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products with other rows for every row whose
    id is divisible by ``every``: ``(query_id, rank, vec_id, score)``, ties to
    the smaller id."""
    spark = df.sparkSession
    ship_package(spark)
    rows = spread(valid_vectors(df, vec_col, F.col(f"`{id_col}`").cast("long").alias("vec_id"))
                  .filter("vec_id is not null"))
    m = (rows.select("v").mapInArrow(_measure(scale), "n long, top long, lo long, hi long")
         .agg(F.sum("n"), F.max("top"), F.min("lo"), F.max("hi")).first())
    if not m[0]:
        return spark.createDataFrame([], RESULT)
    n, top, dim = m[0], m[1], m[3]
    if m[2] != dim:
        raise ValueError("vectors of different lengths")
    block, group = (max(1, min(size, BLOCK_BYTES // max(1, 4 * dim))) for size in (block, group))
    # Any bounded sample does: pivots decide how much is read, not what is found.
    share = min(1.0, SAMPLE / n)
    sample = (rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v")
              .limit(2 * SAMPLE).collect()) or rows.select("v").limit(SAMPLE).collect()
    sampled = integer_matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), scale)
    space = Space(fit_pivots(sampled, top, pivots), top, dim)
    keyed = stored(rows.select("vec_id", "v").mapInArrow(_key(space, scale),
                                                         "row long, vec_id long, pivot int, r double, x binary"), "keyed")
    is_query = F.col("vec_id") % every == 0

    # Annuli: quantiles of each pivot's distances (one row per pivot).
    cuts = [i / rings for i in range(1, rings)]
    per_pivot = keyed.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("nq"),
        F.percentile_approx("r", cuts, 1000).alias("cuts") if cuts else F.array().cast("array<double>").alias("cuts")).collect()
    table = []
    for p in per_pivot:
        want = max(1, min(rings, -(-p["n"] // block)))
        inner = [p["cuts"][i * rings // want - 1] for i in range(1, want)]
        table.append((p["pivot"], inner, max(1, -(-p["nq"] // group))))
    bounds = F.broadcast(spark.createDataFrame(table, "pivot int, cuts array<double>, groups int"))  # at most `pivots` rows
    placed = keyed.join(bounds, "pivot").withColumn(
        "ring", (F.col("pivot") * rings + F.size(F.filter("cuts", lambda c: c < F.col("r")))).cast("int"))
    seen = placed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    meta = np.array(sorted((s["pivot"], s["ring"], max(1, -(-s["n"] // block)), s["lo"], s["hi"]) for s in seen))
    sizes = F.broadcast(spark.createDataFrame([(int(r[1]), int(r[2])) for r in meta], "ring int, blocks int"))
    blocks = stored(_dealt(placed.join(sizes, "ring"), F.col("ring"), F.col("blocks")), "blocks")
    groups = stored(_dealt(placed.filter(is_query), F.col("pivot"), F.col("groups")), "queries")

    best: DataFrame | None = None
    none = F.expr("transform(sequence(1, cast(octet_length(ids) / 8 as int)), i -> cast(null as long))")
    for lo, hi in zip((0, *VISITS), (*VISITS, len(meta))):
        if lo >= len(meta):
            break
        state = groups
        if best is None:
            state = state.withColumn("kth", none)
        else:
            kth = (best.groupBy("g_at", "g_sub", "q").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") >= k).groupBy(F.col("g_at").alias("at"), F.col("g_sub").alias("sub"))
                   .agg(F.map_from_entries(F.collect_list(F.struct("q", "s"))).alias("known")))  # a group's queries
            state = state.join(kth, ["at", "sub"], "left").withColumn(
                "kth", F.expr("transform(sequence(0, cast(octet_length(ids) / 8 as int) - 1), i -> try_element_at(known, i))"))
        pairs = state.select("at", "sub", "ids", "xs", "kth").mapInArrow(
            _visit(space, meta, lo, hi), "ring int, blocks int, pivot int, g_at int, g_sub int, q_ids binary, q_xs binary, "
            "kth array<long>").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = (pairs.join(blocks.withColumnRenamed("at", "ring").hint("merge"), ["ring", "sub"])
                 .select("pivot", "g_at", "g_sub", "q_ids", "q_xs", "kth", "ids", "rs", "xs")
                 .mapInArrow(_score(space, k), FOUND))
        if best is not None:
            found = found.unionByName(best.select(*found.columns))
        w = Window.partitionBy("g_at", "g_sub", "q").orderBy(F.col("score").desc(), "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best")
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
