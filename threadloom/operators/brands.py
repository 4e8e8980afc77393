"""Brand metrics, scores and reasons."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..plans.staging import Scratch
from .quantiles import percentiles

_n = F.count_if


def first_handle(brands: list[str]):
    """The first @mention of a candidate, in lower case; null if there is none."""
    pattern = "(?i)@(" + "|".join(map(re.escape, brands)) + r")\b"
    found = F.lower(F.regexp_extract("text", pattern, 1))
    return F.when(found != "", found)


def _by_brand(rows: DataFrame, flags: list[str], texts: str, distinct: dict[str, tuple[str, str]]) -> DataFrame:
    """brand, rows, the sums of ``flags``, ``texts`` (distinct clean texts with a flag of that name, or all), and distinct counts.

    distinct: name -> (column, flag). Counts add up over (brand, text) first, so that no row is multiplied for a distinct count.
    """
    rows = Scratch(rows.sparkSession, "brands").write(rows, "rows")
    any_ = F.max(texts) if texts in rows.columns else F.lit(True)
    per = rows.groupBy("brand", "clean").agg(F.count(F.lit(1)).alias("_rows"), *(_n(f).alias(f) for f in flags), any_.alias("_counts"))
    out = per.groupBy("brand").agg(
        F.sum("_rows").alias("_rows"), *(F.sum(f).alias(f) for f in flags), _n(F.col("_counts") & F.col("clean").isNotNull()).alias("_texts")
    )
    for name, (column, flag) in distinct.items():
        seen = (rows.where(flag) if flag else rows).where(F.col(column).isNotNull()).select("brand", column).distinct()
        out = out.join(seen.groupBy("brand").agg(F.count(F.lit(1)).alias(name)), "brand", "left").fillna(0, [name])
    return out


def customer_metrics(t: DataFrame, brands: list[str]) -> DataFrame:
    """brand and counts over the inbound messages that mention it first; c_<category> counts the hits of each issue category."""
    mine = t.where("inbound").withColumn("brand", first_handle(brands)).where("brand is not null")
    c = F.col("clean")
    flags = {
        "url_messages": F.col("text").rlike(X.URL), "mention_messages": F.col("text").rlike(X.MENTION), "english_messages": c.rlike(V.ENGLISH),
        **{f"c_{k}": c.rlike(p) for k, p in V.CATEGORIES.items()},
    }
    rows = mine.select("brand", "author", "clean", *(f.alias(k) for k, f in flags.items()))
    out = _by_brand(rows, list(flags), "", {"unique_customers": ("author", "")})
    return out.select("brand", F.col("_rows").alias("customer_messages"), "unique_customers", F.col("_texts").alias("distinct_texts"), *flags)


def reply_metrics(t: DataFrame, brands: list[str]) -> DataFrame:
    """brand and counts over its outbound messages, with what is known of their parents."""
    low = F.lower("author")
    top = t.agg(F.max("id").alias("top"))
    there = t.where("id > 0").groupBy("id").agg(F.max("inbound").alias("p_inbound"), F.max(F.col("clean") != "").alias("p_text"))
    r = t.where(~F.col("inbound") & low.isin([b.lower() for b in brands])).withColumn("brand", low)
    r = r.withColumn("s", X.reply_signals("text", "clean")).crossJoin(F.broadcast(top))
    r = r.join(there.withColumnRenamed("id", "parent"), "parent", "left")
    exists = F.col("p_inbound").isNotNull() & F.col("parent").between(1, F.col("top"))
    valid, generic = F.col("s.valid"), F.col("s.is_generic")
    flags = {
        "valid_replies": valid, "generic_replies": generic, "meaningful_replies": valid & ~generic, "short_replies": F.col("s.is_short"), "url_replies": F.col("s.has_url"),
        "connected_pairs": exists, "usable_pairs": F.coalesce(valid & exists & F.col("p_inbound") & F.col("p_text"), F.lit(False)),
    }
    rows = r.select("brand", "parent", "clean", *(f.alias(k) for k, f in flags.items()))
    out = _by_brand(rows, list(flags), "valid_replies", {"answered_messages": ("parent", "usable_pairs")})
    duplicates = F.greatest(F.col("valid_replies") - F.col("_texts"), F.lit(0)).cast("long").alias("duplicate_replies")
    return out.select(
        "brand", F.col("_rows").alias("replies"), "valid_replies", "generic_replies", "meaningful_replies", "short_replies", "url_replies", duplicates,
        "connected_pairs", "usable_pairs", "answered_messages",
    )


def conversation_metrics(t: DataFrame, brands: list[str], roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """brand, conversations, multi_turn, mean and median size of the threads it writes in."""
    low = F.lower("author")
    own = t.where(~F.col("inbound") & (F.col("id") > 0) & low.isin([b.lower() for b in brands])).select(low.alias("brand"), "id")
    each = own.join(roots, "id").select("brand", "root").distinct().join(sizes, "root")
    each = Scratch(t.sparkSession, "conversations").write(each.select("brand", "size", "is_multi_turn"), "each")
    figures = each.groupBy("brand").agg(
        F.count(F.lit(1)).alias("conversations"), _n("is_multi_turn").alias("multi_turn"), X.rounded(F.avg("size"), 3).alias("average_length")
    )
    medians = percentiles(each, ["brand"], "size", {"median": 0.5}).select("brand", X.rounded("median", 3).alias("median_length"))
    return figures.join(medians, "brand")


def entropy(customers: DataFrame) -> DataFrame:
    """brand, diversity (entropy of category hits over its maximum), active categories (at least 2 % of messages)."""
    k = [f"c_{c}" for c in V.CATEGORIES]
    total = sum((F.col(c) for c in k[1:]), F.col(k[0]))
    h = F.lit(0.0)
    for c in k:
        p = F.col(c) / F.when(total > 0, total)
        h = h - F.coalesce(F.when(F.col(c) > 0, p * F.ln(p)), F.lit(0.0))
    active = sum((F.when(F.col(c) / F.col("customer_messages") >= 0.02, 1).otherwise(0) for c in k), F.lit(0)).cast("long")
    return customers.select("brand", X.rounded(h / math.log(len(k)), 4).alias("diversity"), active.alias("active_categories"))


def scores(replies: DataFrame, customers: DataFrame, talks: DataFrame) -> DataFrame:
    """One row per brand present: metrics, seven sub-scores, selection_score."""
    zero = ["customer_messages", "english_messages", "conversations", "multi_turn"]
    j = replies.join(customers, "brand", "left").join(entropy(customers), "brand", "left").join(talks, "brand", "left")
    j = j.fillna(0, [*zero, "distinct_texts", "active_categories"]).fillna(0.0, ["diversity"])
    meaningful = X.percent(F.col("meaningful_replies"), F.col("valid_replies"))
    english = X.percent(F.col("english_messages"), F.col("customer_messages"))
    repeated = X.ratio(F.col("duplicate_replies"), F.col("valid_replies"))
    over = F.least((F.col("replies") - V.SOFT_REPLIES) / (V.HARD_REPLIES - V.SOFT_REPLIES), F.lit(1.0))
    sub = {
        "groundability": X.rounded(meaningful / 100.0, 4),
        "usable_volume": X.rounded(F.least(F.col("usable_pairs") / V.USABLE_TARGET, F.lit(1.0)), 4),
        "intent_diversity": X.rounded("diversity", 4),
        "multi_turn": X.ratio(F.col("multi_turn"), F.col("conversations")),
        "data_quality": X.rounded(F.greatest(F.lit(0.0), english / 100.0 * (1.0 - repeated)), 4),
        "golden_capacity": X.rounded(F.when(F.col("usable_pairs") >= V.GOLDEN_TARGET, 1.0).otherwise(F.col("usable_pairs") / V.GOLDEN_TARGET), 4),
        "reproducibility": X.rounded(F.when(F.col("replies") <= V.SOFT_REPLIES, 1.0).otherwise(1.0 - 0.5 * over), 4),
    }
    out = j.select(
        "brand", "replies", "customer_messages", "usable_pairs", "conversations", F.col("multi_turn").alias("multi_turn_conversations"),
        meaningful.alias("meaningful_percentage"), "diversity", "active_categories", english.alias("english_percentage"),
        F.col("usable_pairs").alias("golden_set_capacity"), F.floor(F.col("usable_pairs") * V.TEST_SHARE).cast("long").alias("evaluation_capacity"),
        *(c.alias(f"s_{k}") for k, c in sub.items()),
    )
    total = F.lit(0.0)
    for k, w in V.WEIGHTS.items():
        total = total + w * F.col(f"s_{k}")
    return out.withColumn("selection_score", X.rounded(total, 4))


def missing(t: DataFrame, brands: list[str]) -> DataFrame:
    """Candidates without an outbound message."""
    every = t.sparkSession.createDataFrame([(b.lower(),) for b in brands], "brand string")
    return every.join(t.where("not inbound").select(F.lower("author").alias("brand")), "brand", "left_anti")


def rejections(scored: DataFrame) -> DataFrame:
    """brand, reasons: at most two reasons why a brand lost to the best (by score, then name)."""
    best = scored.orderBy(F.desc("selection_score"), "brand").limit(1)
    best = best.select(*(F.col(c).alias(f"w_{c}") for c in best.columns))  # one row
    share = lambda p: F.col(f"{p}multi_turn_conversations") / F.greatest(F.col(f"{p}conversations"), F.lit(1))
    num = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(F.array(
        F.when(F.col("meaningful_percentage") < F.col("w_meaningful_percentage") - 3, F.lit("fewer meaningful replies")),
        F.when(F.col("s_reproducibility") < 0.9, F.lit("large corpus")),
        F.when(F.col("diversity") < F.col("w_diversity") - 0.05, F.lit("narrower issue mix")),
        F.when(share("") < share("w_") - 0.1, F.lit("fewer multi-turn conversations")),
        F.when(F.col("usable_pairs") < F.col("w_usable_pairs") * 0.5, F.concat(F.lit("fewer usable pairs ("), num("usable_pairs"), F.lit(")"))),
    ))
    text = F.when(F.size(reasons) == 0, F.lit("lower overall score")).otherwise(F.array_join(F.slice(reasons, 1, 2), "; "))
    return scored.crossJoin(F.broadcast(best)).where("brand <> w_brand").select("brand", text.alias("reasons"))


def selection_reasons(scored: DataFrame) -> DataFrame:
    """The winner and why, in words."""
    best = scored.orderBy(F.desc("selection_score"), "brand").limit(1)
    return best.select(
        "brand", "selection_score",
        F.format_string("%s%% meaningful replies; %s usable pairs; diversity %s over %s active categories",
                        F.col("meaningful_percentage").cast("string"), F.col("usable_pairs").cast("string"),
                        F.col("diversity").cast("string"), F.col("active_categories").cast("string")).alias("reasons"),
    )

