"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver or per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenry.llm.common import materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their count and two folds of their hashes, observed while they are written."""
    seen = Observation()
    folds = [F.bit_xor(F.xxhash64("u", "v", F.lit(k))).alias(f"h{k}") for k in range(2)]
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), *folds), "edges")
    return out, (seen.get["n"], seen.get["h0"], seen.get["h1"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component), the component being its least node; nodes without links don't appear.

    Large star: each node hands its larger neighbours to the least of its neighbours. Small star: each node hands its
    smaller neighbours and itself to the least. Both need only minima and joins, so a hot node is a skewed join, which
    Spark splits, and never a gathered group. Rounds go on until the edges stay as they are, which they must in the end,
    as each round lowers ends of edges; a path of n nodes takes about log n.
    """
    edges, before = _written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        stars = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        # (u, v) becomes (v, m), and (u, m) comes from the edge with v = m itself
        joined = stars.join(least, "u")
        edges, now = _written(joined.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
