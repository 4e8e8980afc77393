"""Labels of messages: rules, priorities, confidence, escalation; distributions, words and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import text as X
from ..functions import values as V


def label(df: DataFrame, clean: str = "clean") -> DataFrame:
    """Adds matched, intent (taxonomy order), agent_intent (agent order), is_ambiguous, label_rule."""
    m, c = F.col("matched"), F.col(clean)
    out = df.withColumn("matched", I.matched(c))
    out = out.withColumn("intent", I.first_of(m, V.TAXONOMY_ORDER)).withColumn("agent_intent", I.first_of(m, V.AGENT_ORDER))
    return out.withColumn("is_ambiguous", F.size("matched") >= 2).withColumn("label_rule", I.label_rule(m, F.col("intent")))


def assess(labelled: DataFrame, clean: str = "clean") -> DataFrame:
    """Adds points (confidence in hundredths), confidence, band, evidence, escalation (a key), needs_review, reason."""
    c, m, a = F.col(clean), F.col("matched"), F.col("agent_intent")
    out = labelled.withColumn("points", I.confidence_points(c, m, a).cast("long"))
    p = F.col("points")
    out = out.withColumn("confidence", p / F.lit(100.0)).withColumn("band", I.band(p)).withColumn("evidence", I.evidence(c, m, a))
    out = out.withColumn("escalation", I.escalation(c, a, p))
    return out.withColumn("needs_review", F.col("escalation") != "none").withColumn("reason", I.reason_text(F.col("escalation")))


def distribution(labelled: DataFrame, column: str = "intent") -> DataFrame:
    """intent, n for every label, those without a message too."""
    every = labelled.sparkSession.createDataFrame([(n,) for n in V.TAXONOMY_ORDER], "intent string")
    found = labelled.groupBy(F.col(column).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "intent", "left").select("intent", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(labelled: DataFrame) -> DataFrame:
    """intent, n: how often each rule matches."""
    return labelled.select(F.explode("matched").alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def unigrams(df: DataFrame, clean: str = "clean") -> DataFrame:
    """token, n; stopwords left out."""
    stop = F.array(*map(F.lit, V.STOPWORDS))
    return (
        df.select(F.explode(X.tokens(F.col(clean))).alias("token")).where(~F.array_contains(stop, F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )


def bigrams(df: DataFrame, clean: str = "clean") -> DataFrame:
    """first, second, n over neighbouring tokens, stopwords included."""
    t = df.select(X.tokens(F.col(clean)).alias("t")).where(F.size("t") > 1)
    pairs = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))
    return t.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("first"), F.col("p.b").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), *keys).limit(n)


def examples(pairs: DataFrame, most: int = 6, longest: int = 160) -> DataFrame:
    """intent, place, example: the first distinct short redacted texts of each label, by reply id."""
    snippet = X.normalize("customer_redacted_text")
    rows = pairs.select("intent", "brand_tweet_id", snippet.alias("example")).where(F.length("example").between(1, longest))
    key = F.substring(F.lower("example"), 1, 80)
    # the first of each key meets by a combined minimum, so a frequent text stays cheap
    firsts = rows.groupBy("intent", key.alias("key")).agg(F.min(F.struct("brand_tweet_id", "example")).alias("r")).select("intent", "r.*")
    place = F.row_number().over(Window.partitionBy("intent").orderBy("brand_tweet_id"))
    return firsts.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("intent", "place", "example")


def dimension(spark) -> DataFrame:
    """place, intent, definition, includes, excludes, expected_reply: the label vocabulary."""
    rows = [(k, n, V.LABELS[n], *V.SCOPE[n]) for k, n in enumerate(V.TAXONOMY_ORDER)]
    return spark.createDataFrame(rows, "place long, intent string, definition string, includes string, excludes string, expected_reply string")
