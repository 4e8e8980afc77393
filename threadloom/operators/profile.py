"""Profile of a raw message dump: counts, nulls, volumes, times, thread signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_n = lambda c: F.count_if(c)


def dataset_profile(m: DataFrame) -> DataFrame:
    """One row of global counts, in one pass."""
    reply, parent = F.col("response_tweet_id"), F.col("in_response_to_tweet_id")
    true, false = F.coalesce(F.col("inbound") == "True", F.lit(False)), F.coalesce(F.col("inbound") == "False", F.lit(False))
    return m.agg(
        F.count(F.lit(1)).alias("total_rows"), _n(true).alias("inbound_true"), _n(false).alias("inbound_false"),
        _n(~true & ~false).alias("inbound_other"), F.count_distinct("author_id").alias("unique_authors"),
        F.count_distinct(F.when(false, F.col("author_id"))).alias("unique_brands"),
        _n(F.trim(F.regexp_replace(X.text("text"), X.SPACE + "+", " ")) == "").alias("empty_text"),
    )


def threading_signals(m: DataFrame) -> DataFrame:
    reply, parent = F.col("response_tweet_id"), F.col("in_response_to_tweet_id")
    return m.agg(
        _n(reply.isNotNull()).alias("has_response"), _n(parent.isNotNull()).alias("has_in_response_to"), _n(parent.isNull()).alias("roots"),
        _n(reply.isNotNull() & parent.isNotNull()).alias("mid_thread"), _n(F.coalesce(reply.contains(","), F.lit(False))).alias("branching"),
    )


def null_counts(m: DataFrame) -> DataFrame:
    """column, nulls."""
    one = m.agg(*(_n(F.col(c).isNull()).alias(c) for c in m.columns))
    return one.unpivot([], m.columns, "column_name", "nulls")


def brand_volume(m: DataFrame, n: int = 20) -> DataFrame:
    """The authors of most outbound messages; ties by name."""
    out = m.where((F.col("inbound") == "False") & F.col("author_id").isNotNull()).groupBy("author_id").agg(F.count(F.lit(1)).alias("replies"))
    return out.orderBy(F.desc("replies"), "author_id").limit(n)


def time_range(m: DataFrame) -> DataFrame:
    ts = X.created("created_at")
    return m.select(ts.alias("ts")).agg(X.iso(F.min("ts")).alias("first"), X.iso(F.max("ts")).alias("last"), _n(F.col("ts").isNull()).alias("bad_dates"))


def examples(m: DataFrame, n: int = 5) -> DataFrame:
    """The first messages by id, with display texts."""
    rows = m.withColumn("text", X.display_text("text")).orderBy(F.col("tweet_id").try_cast("long"), "tweet_id")
    return rows.limit(n)
