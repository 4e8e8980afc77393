"""The golden set: a pool without repeated texts or conversations, and a seeded stratified sample of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..plans.staging import Scratch

FLAGS = {"short": "is_short", "multi_turn": "is_multi_turn", "ambiguous": "is_ambiguous", "has_url": "has_url"}


def greedy_rows(rows: DataFrame, joined: int = 50) -> DataFrame:
    """The ids that a scan in id order accepts if it takes a row whose text ``a`` and group ``b`` no accepted row has.

    rows: id (unique), a, b. A row is accepted once it is the smallest live id of both its text and its
    group; rows that share either with an accepted row die. That repeats until none is live; the
    result is the sequential one, since an accepted row has no smaller live neighbour. Each round
    settles the smallest live row at least, so that it ends however long a chain of rows is; rows
    with a null are never taken. The tables of ``joined`` rounds become one, so the plan stays small.
    """
    scratch = Scratch(rows.sparkSession, "greedy")
    live, taken = scratch.write(rows.select("id", "a", "b").dropna(), "live"), []
    while live.limit(1).count():
        by_a = live.groupBy("a").agg(F.min("id").alias("ia"))
        by_b = live.groupBy("b").agg(F.min("id").alias("ib"))
        won = scratch.write(live.join(by_a, "a").join(by_b, "b").where("id = ia and id = ib").select("id", "a", "b"), "won")
        taken.append(won.select("id"))
        rest = scratch.write(live.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"), "live")
        scratch.drop(live)
        live = rest
        if len(taken) >= joined:
            taken = [scratch.write(reduce(DataFrame.unionByName, taken), "taken")]
    return reduce(DataFrame.unionByName, taken) if taken else rows.select("id").limit(0)


def pool(labelled: DataFrame) -> DataFrame:
    """Usable labelled pairs, at most one for each customer text (without case) and conversation, with difficulty flags."""
    text = F.lower(F.trim("customer_normalized_text"))
    usable = labelled.where(F.col("is_usable") & (text != ""))
    rows = usable.select(F.col("brand_tweet_id").alias("id"), text.alias("a"), F.col("conversation_id").alias("b"))
    kept = greedy_rows(rows).withColumnRenamed("id", "brand_tweet_id")
    clean = X.clean("customer_text")
    return usable.join(kept, "brand_tweet_id").select(
        "brand_tweet_id", "customer_tweet_id", "conversation_id", "customer_text", "customer_redacted_text", "brand_text", "brand_redacted_text",
        "intent", "matched", "label_rule", "is_ambiguous", "is_generic_reply", "turn_in_conversation",
        F.lower(F.trim("brand_normalized_text")).alias("reply_key"),
        (X.words(clean) <= V.SHORT_MESSAGE_WORDS).alias("is_short"),
        (F.col("is_multi_turn_conversation") | (F.col("turn_in_conversation") > 1)).alias("is_multi_turn"),
        ((F.trim("customer_urls") != "") & X.has_content(clean)).alias("has_url"),
    )


def _leading(p: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first rows of each group in ``order``, one for each reply text: no later row with that text could be picked."""
    first = p.groupBy(by, "reply_key").agg(F.min(F.struct(order, "brand_tweet_id")).alias("f")).select(by, "f.*")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, "brand_tweet_id"))
    return first.withColumn("r", rank).where(F.col("r") <= most).select("brand_tweet_id")


def choose(p: DataFrame, seed: int = 42) -> list[tuple[int, str]]:
    """(brand_tweet_id, sampling_reason). The order is that of md5(seed-id).

    What reaches the driver is bounded by the set's size: for each label and each difficulty the first
    MOST_GOLDEN + PER_INTENT reply texts.
    """
    keyed = p.withColumn("o", F.md5(F.concat(F.lit(f"{seed}-"), F.col("brand_tweet_id").cast("string"))))
    most = V.MOST_GOLDEN + V.PER_INTENT
    ids = _leading(keyed, "intent", "o", most)
    for flag in FLAGS.values():
        ids = ids.unionByName(_leading(keyed.where(flag), flag, "o", most))
    rows = keyed.join(ids.distinct(), "brand_tweet_id").select("brand_tweet_id", "o", "intent", "reply_key", *FLAGS.values()).collect()
    rows = sorted(rows, key=lambda r: (r.o, r.brand_tweet_id))
    chosen, used, flags = {}, set(), {}

    def pick(r, reason: str) -> bool:
        if r.brand_tweet_id in chosen:
            chosen[r.brand_tweet_id].add(reason)
            return False
        if r.reply_key in used:
            return False
        chosen[r.brand_tweet_id], flags[r.brand_tweet_id] = {reason}, r
        used.add(r.reply_key)
        return True

    for label in V.TAXONOMY_ORDER:
        left = V.PER_INTENT
        for r in rows:
            if not left or len(chosen) >= V.MOST_GOLDEN:
                break
            if r.intent == label:
                left -= pick(r, f"intent:{label}")
    for bucket, least in V.TOP_UPS.items():
        have = sum(1 for r in flags.values() if r[FLAGS[bucket]])
        for r in rows:
            if have >= least or len(chosen) >= V.MOST_GOLDEN:
                break
            if r[FLAGS[bucket]]:
                have += pick(r, f"difficulty:{bucket}")
    return sorted((k, ";".join(sorted(v))) for k, v in chosen.items())


def golden(p: DataFrame, seed: int = 42) -> DataFrame:
    """The golden set: at most MOST_GOLDEN rows with the 23 columns."""
    spark = p.sparkSession
    picked = spark.createDataFrame(choose(p, seed), "brand_tweet_id long, sampling_reason string")
    rows = p.join(F.broadcast(picked), "brand_tweet_id")  # as many rows as a golden set has
    place = F.row_number().over(Window.orderBy("intent", "conversation_id", "brand_tweet_id"))
    others = F.array_join(F.array_remove("matched", F.col("intent")), ", ")
    return rows.select(
        F.format_string("gold-%04d", place).alias("golden_id"), "conversation_id", F.col("customer_tweet_id").alias("customer_message_id"),
        F.col("brand_tweet_id").alias("brand_reply_id"), "customer_text", "customer_redacted_text", F.col("brand_text").alias("brand_reply_text"),
        F.col("brand_redacted_text").alias("brand_reply_redacted_text"), "intent", F.lit(True).alias("intent_is_provisional"),
        F.lit("provisional_keyword_rule").alias("label_method"), "label_rule", F.array_join("matched", ";").alias("matched_intents"),
        F.lit("usable_corpus").alias("source_split"), "sampling_reason", "is_short", "is_multi_turn", "is_ambiguous", "is_generic_reply", "has_url",
        "turn_in_conversation", F.lit("pending").alias("annotation_status"),
        F.when(F.col("is_ambiguous") & (others != ""), F.concat(F.lit("ambiguous; also matched: "), others)).otherwise("").alias("notes"),
    )


def golden_summary(g: DataFrame) -> DataFrame:
    """name, n: rows for each label (zeros too) and each flag."""
    counts = [F.count_if(F.col("intent") == n).alias(f"intent:{n}") for n in V.TAXONOMY_ORDER]
    flags = [F.count_if(c).alias(f"flag:{c}") for c in (*FLAGS.values(), "is_generic_reply")]
    one = g.agg(*counts, *flags)
    return one.unpivot([], one.columns, "name", "n")
