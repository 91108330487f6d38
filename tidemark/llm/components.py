"""Connected components of a link table, by repeated joins; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the links (a, b): the root is the smallest node reachable.

    Alternating large-star and small-star steps: every round points each node at the smallest one it knows of,
    and a long chain halves. The edges are written to the shared folder each round. A hub costs no more than
    its own links: minima are taken before the join, which Spark can split where a hub is hot. Loops and
    repeated links do no harm; links with a null end are left out.
    """
    edges = links.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    edges = written(edges, "links")
    state = mark(edges)
    for _ in range(most_rounds):
        edges = written(star(star(edges, both=True), both=False), "links")
        before, state = state, mark(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"the links did not settle in {most_rounds} rounds")


def mark(edges: DataFrame) -> tuple:
    """Count and hash sums of distinct links: equal for equal sets, one pass over the written table."""
    h = F.xxhash64("a", "b")
    sums = [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(F.xxhash64("b", "a"))]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).head())


def star(edges: DataFrame, both: bool) -> DataFrame:
    """Links of every node's neighbours to the smallest among them and itself.

    both: of larger neighbours only (large star, over both directions); else of smaller ones and the node.
    """
    if both:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    rows = near.join(least, "a")
    if both:
        out = rows.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).union(rows.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
