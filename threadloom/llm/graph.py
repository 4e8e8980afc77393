"""Connected components by alternating large-star and small-star rounds, each cut by a scratch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): every node that has an edge, and the smallest node of its component (itself left out).

    edges: u, v (long), in either direction, repeats allowed. Only edges shuffle, and each
    star's centre is found by a map-side combined minimum, so a hot centre stays cheap.
    """
    e = scratch.write(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = scratch.write(
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "small",
        )
        scratch.drop(e, large)
        e, before = small, state
        state = _state(e)
        if state == before:
            return e
    raise RuntimeError("the components did not settle")
