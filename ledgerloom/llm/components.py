"""Connected components of an edge table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.scratch import Scratch

MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one; edges point from the larger end `a` to the smaller end `b`."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), F.least("m", "a").alias("m"))
    joined = both.join(least, both["a"] == least["hub"])
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    Large-star and small-star in turn until nothing changes; every round is written to the shared folder. Loops and
    repeated edges count once; edges with a null end are ignored; no edges give no rows.
    """
    state = scratch.keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                         .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        earlier = state
        state = scratch.keep(_stars(_stars(state, True), False), "stars")
        scratch.drop(earlier)
    else:
        raise RuntimeError("components did not settle")
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
