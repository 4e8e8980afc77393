"""Customer-to-brand reply pairs with quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.filters import marked
from . import threads


def brand_replies(t: DataFrame, brands: list[str]) -> DataFrame:
    """Outbound messages of the brands (matched without case), with brand in lower case."""
    low = F.lower("author")
    return t.where(~F.col("inbound") & (F.col("id") > 0) & low.isin([b.lower() for b in brands])).withColumn("brand", low)


def parents(t: DataFrame, asked: DataFrame) -> DataFrame:
    """parent, p_inbound and p_* of the messages that are asked for, one row per id. asked: one column of ids.

    Only these messages go on, and of those only rows that repeat an id are aggregated: inbound if any is, and the largest row.
    """
    fields = ["text", "author", "created_at", "clean"]
    twice = t.where("id > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    mine = marked(t.where("id > 0").select("id", "inbound", *fields), "id", asked, "_asked").where("_asked")
    mine = marked(mine.drop("_asked"), "id", twice, "_twice")
    one = mine.where("not _twice").select(F.col("id").alias("parent"), F.col("inbound").alias("p_inbound"), *(F.col(c).alias(f"p_{c}") for c in fields))
    many = mine.where("_twice").groupBy("id").agg(F.max("inbound").alias("p_inbound"), F.max(F.struct(*fields)).alias("m"))
    return one.unionByName(many.select(F.col("id").alias("parent"), "p_inbound", *(F.col(f"m.{c}").alias(f"p_{c}") for c in fields)))


def outcomes(t: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies with their parent's columns (p_*) and ``outcome``: why there is no pair, or "candidate"."""
    top = t.agg(F.max("id").alias("top"))
    asked = replies.crossJoin(F.broadcast(top)).where(F.col("parent").between(1, F.col("top"))).select("parent")
    joined = replies.crossJoin(F.broadcast(top)).join(parents(t, asked), "parent", "left")
    outcome = (
        F.when(~F.col("parent").between(1, F.col("top")), "no_parent_id")
        .when(F.col("p_inbound").isNull(), "parent_not_in_data")
        .when(~F.col("p_inbound"), "reply_to_non_customer")
        .otherwise("candidate")
    )
    return joined.withColumn("outcome", outcome).drop("top")


def unusable(brand_norm: Column, customer_norm: Column, customer_clean: Column, brand_clean: Column) -> Column:
    """The first rule that a pair fails; empty if none."""
    return (
        F.when(brand_norm == "", "empty_brand_text")
        .when(customer_norm == "", "empty_customer_text")
        .when(~X.has_content(customer_clean), "customer_only_mention_or_url")
        .when(~X.has_content(brand_clean), "brand_only_mention_or_url")
        .otherwise("")
    )


def interactions(t: DataFrame, brands: list[str], roots: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row per candidate pair: brand, and the 26 columns of the interactions table.

    Of usable pairs of a brand with equal texts (normalized, without case) the one with the smallest
    reply id stays usable. Turns count a conversation's pairs by the customer's time, then reply id.
    """
    if roots is None:
        n = threads.nodes(t)
        roots = threads.roots(n)
        sizes = threads.sizes(n, roots)
    c = outcomes(t, brand_replies(t, brands)).where("outcome = 'candidate'")
    c = c.join(roots, "id").join(sizes, "root")
    c = c.select(
        "*", X.normalize("p_text").alias("cn"), X.normalize("text").alias("bn"),
        X.redact("p_text")["text"].alias("cr"), X.redact("text")["text"].alias("br"),
    )
    c = c.withColumn("failed", unusable(F.col("bn"), F.col("cn"), F.col("p_clean"), F.col("clean")))
    c = c.withColumn("cl", F.lower("cn")).withColumn("bl", F.lower("bn"))
    first = c.where("failed = ''").groupBy("brand", "cl", "bl").agg(F.min("id").alias("first_id"))
    c = c.join(first, ["brand", "cl", "bl"], "left")
    duplicate = (F.col("failed") == "") & (F.col("id") > F.col("first_id"))
    reason = F.when(duplicate, "duplicate").otherwise(F.col("failed"))
    out = c.select(
        "brand",
        F.concat("brand", F.lit("-"), F.col("id").cast("string")).alias("pair_id"),
        F.concat("brand", F.lit("-conv-"), F.col("root").cast("string")).alias("conversation_id"),
        F.col("size").alias("conversation_message_count"),
        F.col("is_multi_turn").alias("is_multi_turn_conversation"),
        F.col("parent").alias("customer_tweet_id"),
        F.col("p_author").alias("customer_author_id"),
        F.lit(True).alias("customer_inbound"),
        X.iso(X.created("p_created_at")).alias("customer_created_at"),
        F.col("p_text").alias("customer_text"),
        F.col("cn").alias("customer_normalized_text"),
        F.col("cr").alias("customer_redacted_text"),
        F.array_join(X.urls("p_text"), " | ").alias("customer_urls"),
        F.col("id").alias("brand_tweet_id"),
        F.col("author").alias("brand_author_id"),
        F.lit(False).alias("brand_inbound"),
        X.iso(X.created("created_at")).alias("brand_created_at"),
        F.col("text").alias("brand_text"),
        F.col("bn").alias("brand_normalized_text"),
        F.col("br").alias("brand_redacted_text"),
        F.array_join(X.urls("text"), " | ").alias("brand_urls"),
        F.col("parent").alias("in_response_to_tweet_id"),
        X.reply_signals("text", "clean")["is_generic"].alias("is_generic_reply"),
        duplicate.alias("is_duplicate"),
        (reason == "").alias("is_usable"),
        reason.alias("unusable_reason"),
    )
    turn = Window.partitionBy("conversation_id").orderBy("customer_created_at", "brand_tweet_id")
    return out.withColumn("turn_in_conversation", F.row_number().over(turn).cast("long"))


def summary(t: DataFrame, pairs: DataFrame, brands: list[str]) -> DataFrame:
    """One row per brand: counts of replies, outcomes, pairs, flags and redactions."""
    o = outcomes(t, brand_replies(t, brands)).groupBy("brand").agg(
        F.count(F.lit(1)).alias("replies"),
        *(F.count_if(F.col("outcome") == k).alias(k) for k in ("no_parent_id", "parent_not_in_data", "reply_to_non_customer", "candidate")),
    )
    p = pairs.groupBy("brand").agg(
        F.count_if("is_usable").alias("usable"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("is_usable") & F.col("is_generic_reply")).alias("generic_usable"),
        F.count_distinct(F.when(F.col("is_usable"), F.col("conversation_id"))).alias("conversations_with_usable"),
        F.count_if(F.col("brand_created_at") == "").alias("bad_reply_dates"),
    )
    zero = {c: 0 for c in ("usable", "duplicates", "generic_usable", "conversations_with_usable", "bad_reply_dates")}
    return o.join(p, "brand", "left").fillna(zero).withColumn("generic_usable_percentage", X.percent(F.col("generic_usable"), F.col("usable")))
