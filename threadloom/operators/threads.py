"""Reply threads: edges, roots by pointer doubling, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import Scratch
from .quantiles import percentiles


def nodes(t: DataFrame) -> DataFrame:
    """id, up, inbound: one row per id. up is the parent if it lies in 1..max(id), else the id itself.

    Rows that repeat an id count once: inbound if any is, the largest parent in range.
    """
    top = t.agg(F.max("id").alias("top"))  # one row
    ranged = t.where("id > 0").crossJoin(F.broadcast(top)).select("id", "inbound", F.when(F.col("parent").between(1, F.col("top")), F.col("parent")).alias("up"))
    return ranged.groupBy("id").agg(F.coalesce(F.max("up"), F.col("id")).alias("up"), F.max("inbound").alias("inbound"))


def roots(n: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, root. A parent that is in range but not in the data is a root too (a ghost); of a cycle the smallest id on it is.

    Each round doubles the length of the pointers, so a chain of n needs about log2(n) rounds; every round is a scratch
    table. A pointer carries the smallest id on its way. Once a round settles no more, those left lead into cycles, and pointers
    longer than they are many have gone all around; 64 rounds do for any number.
    """
    scratch = Scratch(n.sparkSession, "roots")
    p = scratch.write(n.select("id", "up", F.least("id", "up").alias("low"), (F.col("id") == F.col("up")).alias("settled")), "pointers")
    steps, before = 1, None
    for _ in range(most_rounds):
        q = p.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("on"), F.col("settled").alias("there"))
        ghost = F.col("next").isNull()
        stepped = p.join(q, "up", "left").select(
            "id", F.when(F.col("settled") | ghost, F.col("up")).otherwise(F.col("next")).alias("up"),
            F.least("low", "on").alias("low"), (F.col("settled") | ghost | F.col("there")).alias("settled"),
        )
        stepped = scratch.write(stepped, "pointers")
        scratch.drop(p)
        p, steps = stepped, 2 * steps
        left = p.where("not settled").count()
        if not left or (left == before and steps >= left):
            break
        before = left
    if not left:
        return p.select("id", F.col("up").alias("root"))
    around = p.where("not settled").select(F.col("id").alias("up"), F.col("low").alias("least"))
    least = F.when(F.col("settled"), F.col("up")).otherwise(F.col("least"))
    return p.join(around, "up", "left").select("id", least.alias("root"))


def sizes(n: DataFrame, r: DataFrame) -> DataFrame:
    """root, size, n_inbound, n_outbound, is_multi_turn."""
    g = n.join(r, "id").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.count_if("inbound").alias("n_inbound"))
    out = F.col("size") - F.col("n_inbound")
    return g.select("root", "size", "n_inbound", out.alias("n_outbound"), ((F.col("size") >= 3) & (F.col("n_inbound") >= 1) & (out >= 1)).alias("is_multi_turn"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, min, p10, p25, median, p75, p90, p95, max; percentiles exact, cut to integers."""
    shares = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    df = Scratch(df.sparkSession, "distribution").write(df.select(F.col(column).cast("double").alias("c")), "values")
    figures = df.agg(
        F.count("c").alias("count"), X.rounded(F.avg("c"), 3).alias("mean"), F.min("c").cast("long").alias("min"), F.max("c").cast("long").alias("max")
    )
    p = percentiles(df, [], "c", shares)
    both = figures.crossJoin(F.broadcast(p))  # one row each
    return both.select("count", "mean", "min", *(F.col(k).cast("long").alias(k) for k in shares), "max")


BUCKETS = ["1", "2", "3", "4", "5", "6-10", "11+"]


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bucket, n for the buckets 1 to 5, 6-10 and 11+; empty buckets stay."""
    c = F.col(column)
    name = F.when(c <= 5, c.cast("string")).when(c <= 10, "6-10").otherwise("11+")
    every = df.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    found = df.groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
