"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Scratch


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
    ).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    sym = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
            )
        ).alias("e")
    ).select("e.u", "e.v")
    least = sym.groupBy("u").agg(F.min("v").alias("m"))
    return (
        sym.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` has integer columns ``a`` and ``b``; loops and repeats are ignored, nulls
    dropped. Returns ``node, component`` with the least node of the component; the least
    node itself is included. Both steps are joins and partial aggregations, so a hub needs
    no task that holds all its neighbours as one group. Each round is written to the shared
    scratch folder, so a lost executor costs at most one round.
    """
    cur = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = scratch.table(cur, f"{label}-0")
    seen = _digest(cur)
    for k in range(1, max_rounds + 1):
        if seen[0] == 0:
            break
        cur = scratch.table(_small_star(_large_star(cur)), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
