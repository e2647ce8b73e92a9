"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import materialize

ROUNDS = 40


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them.

    A large star moves the neighbours above a node, a small star those below it. Nodes with
    many links are pre-aggregated for the smallest neighbour; the join splits them.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        moved = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b")
        return moved.where("a <> b").distinct()
    down = both.where("b < a")
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b")
    return moved.union(low.select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for all nodes of links ``a``, ``b``.

    Every round's links are written to the shared folder, so a lost executor costs one round.
    Rounds grow with the logarithm of the longest path.
    """
    now = materialize(links.where("a <> b").select("a", "b").distinct(), "stars")
    before = None
    for _ in range(ROUNDS):
        now = _star(_star(now, large=True), large=False)
        both = {"n": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
        now, seen = materialize(now, "stars", both)
        state = (seen["n"], seen["sum"])
        if state == before or not seen["n"]:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    pairs = now.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node"))
    roots = pairs.select(F.col("root").alias("node"), "root")
    return pairs.select("node", "root").union(roots).distinct()
