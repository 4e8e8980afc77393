"""Labels on a stream: the batch expressions are stateless, so they run unchanged under readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import labels


def label_stream(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean, labels, confidence and escalation to each message."""
    return labels.assess(labels.label(messages.withColumn("clean", X.clean(text))))


def label_counts(messages: DataFrame, time: str, text: str = "text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, agent_intent, n: counts per time window; messages later than ``late`` are left out by the watermark."""
    labelled = label_stream(messages, text).withWatermark(time, late)
    return labelled.groupBy(F.window(time, window).alias("window"), "agent_intent").agg(F.count(F.lit(1)).alias("n"))
