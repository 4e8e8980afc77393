"""Typed messages from raw strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.io import require


def _id(c: str):
    return F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def typed(messages: DataFrame) -> DataFrame:
    """id, parent (0 where there is none), inbound, author, created_at, text, clean; bad ids become 0."""
    require(messages, ["tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"], "messages")
    return messages.select(
        _id("tweet_id").alias("id"),
        _id("in_response_to_tweet_id").alias("parent"),
        F.coalesce(F.col("inbound") == "True", F.lit(False)).alias("inbound"),
        X.text("author_id").alias("author"),
        X.text("created_at").alias("created_at"),
        X.text("text").alias("text"),
        X.clean("text").alias("clean"),
    )
