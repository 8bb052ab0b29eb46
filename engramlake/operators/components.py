"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.session import checkpointed


def _to_minimum(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour v of u (v > u only, or all and u itself) linked to the least of u and its neighbours.
    The least is an aggregate that is joined back, so that a node with very many neighbours is split like any skewed join."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = pairs.join(least, "u")
    if larger_only:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (u, v): the least node that it is connected with.

    Loops, null ends and repeated edges count for nothing; a node with loops only is left out. The result is whole
    whatever the shape of the graph: rounds, logarithmic in practice, go on until nothing moves, else an error is raised.
    """
    now = checkpointed(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, larger_only=True)
        now = checkpointed(_to_minimum(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger_only=False))
        after = print_of(now)
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
