"""Exact order statistics of all groups together, by histograms that narrow round by round.

A round cuts what is left around each rank into BINS bins and keeps the bin that has it; values that are alike are
counted once. No group's values meet in one task, and a rank's range shrinks by a factor of BINS, so that a few rounds do
for any doubles. Only counts and the ranges, a row for each group and rank, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import Scratch

BINS = 4096


def _narrowed(counted: DataFrame, open_: DataFrame) -> DataFrame:
    """The ranges of ``open_`` (g, rank, rest, lo, hi), each cut down to the bin that has the value of its rank."""
    ranges = open_.select("g", "lo", "hi").distinct()
    width = (F.col("hi") - F.col("lo")) / (BINS - 1)
    # the least value has a bin of its own, so that a range always shrinks
    at = F.when(F.col("v") == F.col("lo"), 0).otherwise(1 + F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 2)))
    inside = counted.join(ranges, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
    bins = inside.groupBy("g", "lo", "hi", at.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("b"))  # of at most BINS rows
    bins = bins.withColumn("upto", upto)
    met = open_.join(bins, ["g", "lo", "hi"]).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
    return met.select("g", "rank", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.col("low").alias("lo"), F.col("high").alias("hi"))


def order_statistics(counted: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, rank, v: the values at ranks from 0. counted: g, v (double), n, a row for each value; ranks: g, rank, within the group's rows."""
    scratch = Scratch(counted.sparkSession, "ranks")
    ends = counted.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    left = scratch.write(ranks.join(ends, "g").select("g", "rank", F.col("rank").alias("rest"), "lo", "hi"), "ranges")
    done = []
    while True:
        done.append(left.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        open_ = left.where("lo < hi")
        if not open_.limit(1).count():
            break
        left = scratch.write(_narrowed(counted, open_), "ranges")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def percentiles(df: DataFrame, groups: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """groups, and for each of ``shares`` (name: 0 to 1) the exact percentile, between two values by linear interpolation.

    Nulls in the value don't count; a group of nothing else has null percentiles, and so has the only row of an empty table
    without groups. A null in the groups is a group of its own.
    """
    scratch = Scratch(df.sparkSession, "percentiles")
    g = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counted = scratch.write(df.select(g.alias("g"), v.alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "counted")
    known = counted.where("v is not null")
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for k, p in shares.items())))
    asked = known.groupBy("g").agg(F.sum("n").alias("total")).select("g", place.alias("x")).select("g", "x.name", "x.at")
    asked = scratch.write(asked.select("*", F.floor("at").alias("below"), F.ceil("at").alias("above")), "asked")
    found = order_statistics(known, asked.select("g", F.explode(F.array("below", "above")).alias("rank")).distinct())
    low, high = (found.select("g", F.col("rank").alias(name), F.col("v").alias(f"v_{name}")) for name in ("below", "above"))
    at = asked.join(low, ["g", "below"]).join(high, ["g", "above"])
    between = (F.col("above") - F.col("at")) * F.col("v_below") + (F.col("at") - F.col("below")) * F.col("v_above")
    values = at.select("g", "name", F.when(F.col("above") == F.col("below"), F.col("v_below")).otherwise(between).alias("p"))
    wide = values.groupBy("g").agg(*(F.max(F.when(F.col("name") == k, F.col("p"))).alias(k) for k in shares))
    every = counted.select("g").distinct() if groups else df.sparkSession.range(1).select(g.alias("g"))
    return every.join(wide, "g", "left").select(*(F.col(f"g.`{c}`") for c in groups), *shares)
