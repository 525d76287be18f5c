"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached from it.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed twice, and the edges
    are carried over to the roots; edges inside a root vanish. Pointers only ever go down, so there are no cycles. Hot nodes
    are summed up by ``min`` before the shuffle. Every round is a written table, so a lost executor costs one round at most.
    Self loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    left = written(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    named = None
    while not left.isEmpty():
        down = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        down = written(down, "roots")
        for _ in range(2):
            up = down.select(F.col("node").alias("root"), F.col("root").alias("above"))
            down = down.join(up, "root").select("node", F.col("above").alias("root"))
        down = written(down, "roots")
        if named is None:
            named = down.select("node", F.col("root").alias("component"))
        else:
            here = down.select(F.col("node").alias("component"), "root")
            named = named.join(here, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            named = written(named, "components")
        a, b = down.select(F.col("node").alias("a"), F.col("root").alias("to_a")), down.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        left = left.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        left = written(left, "edges")
    if named is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named
