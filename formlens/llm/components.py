"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """One star step: hang the larger (or the smaller and itself) neighbours of each node on its least neighbour.

    The least neighbour of a node with many is broadcast, so the centre of a large component doesn't meet its edges in one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = Names(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), scratch, f"{name}-low")
    joined = low.join(both, ["u"])
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = low.rows.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).filter("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs -> (node, component), component being the least node reachable.

    Both directions and self-loops may be given. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. An empty table gives no rows.
    """
    a = edges.filter("u is not null and v is not null and u <> v")
    a = a.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    a = scratch.save(a, f"{name}-0")
    seen = None
    for i in range(1, rounds + 1):
        a = scratch.save(_star(a, True, scratch, f"{name}-{i}-large"), f"{name}-{i}-half")
        a = scratch.save(_star(a, False, scratch, f"{name}-{i}-small"), f"{name}-{i}")
        state = a.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    pairs = a.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(a.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
