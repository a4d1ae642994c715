"""Connected components of an edge table as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> ``(node, root)`` for every node of an edge.

    Each round maps every node to the neighbour (or itself) of the smallest
    hash under that round's seed and renames the edges, so the graph shrinks
    by a constant factor a round whatever its shape (long chains too).  Hubs
    are safe: the smallest neighbour is an aggregate with map-side combine,
    and no neighbour list is gathered.  Every round's tables are written to
    the shared folder.  Loops and repeated edges are allowed; an empty table
    gives an empty result."""
    cur = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while not cur.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = stored(both.groupBy("u").agg(F.min(rank("v")).alias("best"))
                    .select(F.col("u").alias("node"), F.least(F.col("best"), rank("u"))["n"].alias("next")),
                    "step")
        if labels is None:
            labels = to.select("node", F.col("next").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), "next")
            labels = (labels.join(step, "root", "left")
                      .select("node", F.coalesce("next", "root").alias("root")))
        a = to.select(F.col("node").alias("u"), F.col("next").alias("a"))
        b = to.select(F.col("node").alias("v"), F.col("next").alias("b"))
        cur = stored(cur.join(a, "u").join(b, "v").filter("a <> b")
                     .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        turn += 1
    if labels is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(labels, "labels")
