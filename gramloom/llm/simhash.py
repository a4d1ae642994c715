"""Operator 7, SimHash near-duplicates with a Gray-order hierarchical index.

**Fingerprints.**  A text is lower-cased (A-Z only), split on ASCII white
space into word shingles, repeats included; each shingle gives an XXH64, and
a fingerprint bit is 1 if it is set in over half of them.

**Index.**  Equal fingerprints are first merged.  Any two fingerprints with
at most ``d`` differing bits agree on at least ``blocks - d`` of ``blocks``
bit blocks, so every fingerprint is filed under each choice of
``blocks - d`` blocks: the masked bit pattern is an upper node of the index,
reached with no difference.  Spark shuffles by upper node and sorts its
members by Gray rank.  Inside a node, neighbours in Gray order form groups of
``FANOUT``, those again groups, and so on; each group keeps the bits that all
its members share.  The self-join walks pairs of groups from the top, adds
the differences on newly shared bits to those of the parents and drops the
whole pair beyond ``d``.  Pairs of groups already known to be one component
are dropped too, so a dense group of near copies isn't compared pair by pair,
and only a spanning star of each node's links is emitted.

A node of more than ``NODE_LIMIT`` distinct fingerprints isn't searched in
one task: its members are linked through the patterns at ``d / 2`` flipped
bits around each (two fingerprints at most ``d`` apart share one), an exact
and linear way that any number of tasks can share.

Defined cases: null text is empty; an empty text has fingerprint zero and is
linked like any other; a null document id is kept and ignored as a class id
where another id exists; repeated rows fall into one class; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import fresh, ship_package, spread, stored, text_or_empty
from gramloom.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCKS = 7
FANOUT = 16
NODE_LIMIT = 1 << 17
CHUNK = 1 << 16
SALTS = 32


def fingerprint_of(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash
    h = xxhash.xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    line = b" ".join(words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hs = np.array([h(line[s:e], seed) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], "<u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """64-bit fingerprint of a text column as a (signed) long."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t, shingle, seed) for t in texts.to_pylist()], np.uint64)
                        .view(np.int64))
    return of(text)


def gray_rank(x: Column) -> Column:
    """Position of a bit pattern in the reflected Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def block_masks(blocks: int, d: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - d`` blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - d)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of ``a[i]`` and ``b[i]`` in a table of roots."""
    while True:
        ra, rb = label[a], label[b]
        ne = ra != rb
        if not ne.any():
            return label
        a, b = a[ne], b[ne]
        np.minimum.at(label, np.maximum(ra, rb)[ne], np.minimum(ra, rb)[ne])
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump


def _same(label: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The label of each group if its members share one, else -1."""
    lo, hi = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
    return np.where(lo == hi, lo, -1)


def node_links(x: np.ndarray, d: int) -> np.ndarray:
    """Component roots (positions) of the fingerprints ``x`` of one node,
    sorted by Gray rank, under "at most ``d`` bits differ"."""
    m = len(x)
    near = np.bitwise_count(x[1:] ^ x[:-1]) <= d
    label = np.arange(m)
    label = _merge(label, np.flatnonzero(near), np.flatnonzero(near) + 1)
    masks, pats, starts = [np.full(m, ~np.uint64(0))], [x], []
    while len(pats[-1]) > FANOUT:
        at = np.arange(0, len(pats[-1]), FANOUT)
        all_and = np.bitwise_and.reduceat(pats[-1], at)
        all_or = np.bitwise_or.reduceat(pats[-1], at)
        mask = np.bitwise_and.reduceat(masks[-1], at) & ~(all_and ^ all_or)
        # A member's pattern is zero where its own group disagrees; such bits are out of every mask above.
        starts.append(at)
        masks.append(mask)
        pats.append(all_and & mask)
    top = len(pats) - 1

    def labels_at(level: int) -> np.ndarray:
        out = label
        for k in range(level):
            out = _same(out, starts[k])
        return out

    n = len(pats[top])
    i, j = np.triu_indices(n)
    none = np.zeros(len(i), np.uint64)
    todo = [(top, i, j, np.zeros(len(i), np.int64), none)]
    while todo:
        level, i, j, acc, seen = todo.pop()
        if len(i) > CHUNK:
            for lo in range(0, len(i), CHUNK):
                todo.append((level, i[lo:lo + CHUNK], j[lo:lo + CHUNK], acc[lo:lo + CHUNK], seen[lo:lo + CHUNK]))
            continue
        same = labels_at(level)
        shared = masks[level][i] & masks[level][j]
        acc = acc + np.bitwise_count((pats[level][i] ^ pats[level][j]) & shared & ~seen)
        live = (acc <= d) & ~((same[i] == same[j]) & (same[i] >= 0))
        i, j, acc, shared = i[live], j[live], acc[live], shared[live]
        if not len(i):
            continue
        if level == 0:
            label = _merge(label, i, j)
            continue
        size = len(pats[level - 1])
        step = np.arange(FANOUT)
        ci = (i[:, None, None] * FANOUT + step[None, :, None])
        cj = (j[:, None, None] * FANOUT + step[None, None, :])
        ok = (ci < size) & (cj < size) & ((i != j)[:, None, None] | (ci < cj if level == 1 else ci <= cj))
        at = np.nonzero(ok)
        ci, cj = np.broadcast_to(ci, ok.shape)[at], np.broadcast_to(cj, ok.shape)[at]
        todo.append((level - 1, ci, cj, acc[at[0]], shared[at[0]]))
    return label


def _small_links(x: np.ndarray, node: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of many small nodes at once: positions (i, j)."""
    left, right = [], []
    at = np.arange(len(x) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(x)]
        at = at[node[at] == node[at + step]]
        hit = at[np.bitwise_count(x[at] ^ x[at + step]) <= d]
        left.append(hit)
        right.append(hit + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _search(d: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v, hot=False):
            return pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), hot))],
                names=["u", "v", "hot"])

        def solve(node, x):
            """Whole nodes, sorted by (node, Gray rank)."""
            cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[cut, len(x)])
            small = np.repeat(size <= FANOUT, size)
            xs = x[small]
            i, j = _small_links(xs, np.repeat(np.arange(len(cut)), size)[small], d)
            if len(i):
                yield out(xs[i], xs[j])
            for lo, n in zip(cut[size > FANOUT], size[size > FANOUT]):
                part = x[lo:lo + n]
                root = node_links(part, d)
                far = np.flatnonzero(root != np.arange(n))
                if len(far):
                    yield out(part[far], part[root[far]])

        held_n, held_x, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            node = np.asarray(b.column(0)).astype(np.int64)
            x = np.asarray(b.column(1)).astype(np.int64).view(np.uint64)
            if hot is not None:  # the rest of a node beyond the limit
                more = node == hot
                if more.any():
                    yield out(x[more], x[more], True)
                    node, x = node[~more], x[~more]
                    if not len(node):
                        continue
                hot = None
            node, x = np.r_[held_n, node], np.r_[held_x, x]
            last = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])[-1] if len(node) else 0
            if last:
                yield from solve(node[:last], x[:last])
            held_n, held_x = node[last:], x[last:]
            if len(held_x) > limit:
                hot = held_n[0]
                yield out(held_x, held_x, True)
                held_n, held_x = held_n[:0], held_x[:0]
        if len(held_x):
            yield from solve(held_n, held_x)
    return run


def _around(d: int):
    flips = [0] + [sum(1 << b for b in c) for k in range(1, d // 2 + 1) for c in combinations(range(64), k)]
    flips_a = np.array(flips, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(x), 64):
                some = x[lo:lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some, len(flips_a)).view(np.int64)),
                     pa.array((some[:, None] ^ flips_a[None, :]).ravel().view(np.int64))], names=["fp", "mid"])
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``) whose
    components are those of "at most ``max_bits`` bits differ"."""
    ship_package(fps.sparkSession)
    if not max_bits < blocks or max_bits % 2:
        raise ValueError("max_bits must be even and below blocks")
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, max_bits)])
    filed = (fps.select("fp", F.posexplode(masks).alias("table", "mask"))
             .select(F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp"))
    found = stored(filed.repartition("node").sortWithinPartitions("node", gray_rank(F.col("fp")))
                   .mapInArrow(_search(max_bits, node_limit), "u long, v long, hot boolean"), "links")
    out = found.filter("not hot").select("u", "v")
    hot = found.filter("hot").select(F.col("u").alias("fp")).distinct()
    if not hot.isEmpty():
        mids = stored(hot.mapInArrow(_around(max_bits), "fp long, mid long"), "around")
        first = mids.groupBy("mid").agg(F.min("fp").alias("v"))
        out = out.unionByName(mids.join(first, "mid").select(F.col("fp").alias("u"), "v"))
    return out.filter("u <> v").distinct()


def classes(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
            node_limit: int = NODE_LIMIT) -> DataFrame:
    """Rows ``(doc_id, fp)`` -> one row per distinct fingerprint:
    ``(fp, component_id, rep_fp)``, the smallest document id reachable and
    the fingerprint that document has."""
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    roots = components(links(first.select("fp"), max_bits, blocks, node_limit))
    # Salted: the fingerprints of a large class meet its result in SALTS tasks.
    joined = (first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("salt", F.expr(f"cast(pmod(xxhash64(fp), {SALTS}L) as int)")))
    best = (joined.filter("root is not null").groupBy("root")
            .agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "fp")).alias("best"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    # Not broadcast: the classes grow with the documents.
    return (joined.join(best.hint("shuffle_hash"), ["root", "salt"], "left")
            .select("fp", F.when(F.col("best").isNull(), F.col("doc")).otherwise(F.col("best.doc")).alias("component_id"),
                    F.coalesce("best.fp", "fp").alias("rep_fp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, fp, component_id)``."""
    ship_package(docs.sparkSession)
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")))
    fps = stored(rows.select("doc_id", fingerprint(F.col("t"), shingle).alias("fp")), "fingerprints")
    return (fps.join(classes(fps, max_bits).select("fp", "component_id"), "fp")
            .select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class left: that of the smallest id
    (among rows equal in id and fingerprint, that of the smallest text hash)."""
    ship_package(docs.sparkSession)
    fp = fresh(docs, "fp")
    table = stored(spread(docs).withColumn(fp, fingerprint(text_or_empty(text_col), shingle)), "with_fp")
    ids = table.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    reps = (classes(ids, max_bits).filter("fp = rep_fp")
            .select(F.col("component_id").alias("rep_doc"), F.col("fp").alias("rep_fp")))
    kept = table.join(reps, (F.col(fp) == F.col("rep_fp")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("rep_doc")),
                      "left_semi")
    row = fresh(kept, "row")
    one = Window.partitionBy(fp, f"`{id_col}`").orderBy(F.xxhash64(text_or_empty(text_col)))
    return kept.withColumn(row, F.row_number().over(one)).filter(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
