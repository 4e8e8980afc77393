"""The message adapter: a raw message dump (all strings, seven columns) made from ``events``, for tests and queries.

Six events make a thread: customer and brand take turns, with branches, ghost parents, parents out of
range, bad dates and repeated texts, all by rules on the event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]
BRANDS = [f"Brand{k:02d}" for k in range(25)]

CUSTOMER = [
    "My delivery has not arrived",
    "half my items were missing from my order",
    "I was charged twice for my order",
    "my clubcard points are missing",
    "is the gluten free bread back in stock",
    "huge queue at the till in your store",
    "I cannot log into my account",
    "I want to speak to a human",
    "I will take legal action over this",
    "asdfghjkl qwerty zzz",
    "thanks",
    "",
    "https://ex.co/photo",
    "the driver was late and the van blocked my drive",
    "how do i cancel my order",
    "please refund the duplicate charge to my card",
    "do you have any loyalty vouchers or points left",
    "what time is the branch open on sunday",
    "this is disgusting mouldy bread and the staff were rude, poor service",
    "call me on 07123 456789 or mail joe.bloggs@example.com about ref 998877",
    "the item was substituted and discontinued, I was overcharged",
    "as a courtesy could you tell me the opening hours",
    "still waiting for my delivery slot, nobody has helped, third time now",
    "app not working and website error when i reset my password",
    "   ",
    "wrong item in my online order, checkout basket and payment declined",
    "where can i find the petrol station and car park",
    "can't log in, locked out of my account again",
    "sold out everywhere, when will it be back",
]
REPLY = [
    "Please DM us",
    "Please send us a DM with your details https://ex.co/help so that our team can look",
    "Sorry about that",
    "Call 12345 now",
    "We are very sorry to hear about this and we hope that things get better for you soon",
    "Please check the tracking link in your account and confirm the order number with the store",
    "",
    "@12345",
    "https://ex.co/only",
    "Your refund has been sorted and the payment will show in 3 days",
    "Thanks for letting us know, follow us and drop us a DM",
    "Have you tried to restart the app and update the settings",
    "We've passed this on to the manager of the branch",
]

#: What some messages go on with, by a divisor of the event id: beyond 160, 240, 600 and 2000 characters; and a long reply.
LONGER = {
    202: " my order came with items missing " + "and nobody at the shop could tell me why " * 4,
    206: " the queue at the till was long " + "and the staff in the branch were rude to me " * 6,
    214: " i was charged twice for one order " + "and i still wait for the refund to my card " * 15,
    218: " my delivery never came " + "and the driver did not call me " * 70,
}
LONGER_REPLY = (203, " please send us the order number " + "and the address of the branch so that the team can look into it " * 5)


def _pick(templates: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, templates)), (place % len(templates) + 1).cast("int"))


def from_events(events: DataFrame) -> DataFrame:
    """RAW_COLUMNS, all strings. events: event_id (from 0, without gaps), ts, user_id."""
    e = F.col("event_id")
    b, p = F.floor(e / 6), e % 6
    s = F.when(b % 10 == 9, b - 1).otherwise(b)
    customer = p.isin(0, 2, 4)
    brand = F.concat(F.lit("Brand"), F.lpad((s % 25).cast("string"), 2, "0"))
    t = e + 1
    parent = (
        F.when(t % 89 == 0, F.lit(None).cast("long"))
        .when(t % 97 == 0, t + 5_000_000)
        .when((t % 101 == 0) & p.isin(3, 5), t - 2)
        .when(p == 0, F.lit(None).cast("long"))
        .when(p == 4, t - 3)
        .otherwise(t - 1)
    )
    place = s * 7 + p * 11
    longer = F.coalesce(*(F.when(e % k == 0, more) for k, more in LONGER.items()), F.lit(""))
    asked = F.when(e % 134 == 0, "  ").otherwise(F.concat(
        F.lit("@"), brand, F.lit(" "), _pick(CUSTOMER, place), F.when(s % 3 == 0, F.concat(F.lit(" order "), (s + 10_000_000).cast("string"))).otherwise(""), longer
    ))
    said = F.concat(
        F.lit("@"), (s + 100_000).cast("string"), F.lit(" "), _pick(REPLY, place),
        F.when(s % 4 == 0, F.concat(F.lit(" https://ex.co/"), s.cast("string"))).otherwise(""),
        F.when(e % LONGER_REPLY[0] == 0, LONGER_REPLY[1]).otherwise(""),
    )
    when = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    rows = events.where(e % 307 != 306).select(
        t.alias("id"),
        F.when(customer, F.col("user_id").cast("string")).when(e % 13 == 0, F.upper(brand)).otherwise(brand).alias("author_id"),
        F.when(e % 211 == 210, "maybe").when(customer, "True").otherwise("False").alias("inbound"),
        F.when(e % 50 == 49, "bad date").otherwise(when).alias("created_at"),
        F.when(customer, asked).otherwise(said).alias("text"),
        parent.alias("parent"),
    )
    children = rows.where("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_list("id")).alias("c"))
    children = children.select("parent", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("response_tweet_id"))
    out = rows.join(children.withColumnRenamed("parent", "id"), "id", "left")
    return out.select(
        F.col("id").cast("string").alias("tweet_id"), "author_id", "inbound", "created_at", "text", "response_tweet_id",
        F.col("parent").cast("string").alias("in_response_to_tweet_id"),
    )


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same rows in DuckDB SQL, as the body of a CTE named messages.
SQL = f"""
SELECT CAST(t AS VARCHAR) AS tweet_id,
  CASE WHEN p IN (0, 2, 4) THEN CAST(user_id AS VARCHAR) WHEN e % 13 = 0 THEN upper(brand) ELSE brand END AS author_id,
  CASE WHEN e % 211 = 210 THEN 'maybe' WHEN p IN (0, 2, 4) THEN 'True' ELSE 'False' END AS inbound,
  CASE WHEN e % 50 = 49 THEN 'bad date' ELSE strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') END AS created_at,
  CASE WHEN p IN (0, 2, 4) AND e % 134 = 0 THEN '  ' WHEN p IN (0, 2, 4)
    THEN '@' || brand || ' ' || list_extract([{', '.join(map(sql_text, CUSTOMER))}], (s * 7 + p * 11) % {len(CUSTOMER)} + 1)
      || CASE WHEN s % 3 = 0 THEN ' order ' || (s + 10000000) ELSE '' END
      || CASE {' '.join(f"WHEN e % {k} = 0 THEN {sql_text(more)}" for k, more in LONGER.items())} ELSE '' END
    ELSE '@' || (s + 100000) || ' ' || list_extract([{', '.join(map(sql_text, REPLY))}], (s * 7 + p * 11) % {len(REPLY)} + 1)
      || CASE WHEN s % 4 = 0 THEN ' https://ex.co/' || s ELSE '' END || CASE WHEN e % {LONGER_REPLY[0]} = 0 THEN {sql_text(LONGER_REPLY[1])} ELSE '' END END AS text,
  string_agg(kid, ',' ORDER BY kid_id) AS response_tweet_id,
  CAST(parent AS VARCHAR) AS in_response_to_tweet_id
FROM (SELECT *, CAST('Brand' || lpad(CAST(s % 25 AS VARCHAR), 2, '0') AS VARCHAR) AS brand,
        CASE WHEN t % 89 = 0 THEN NULL WHEN t % 97 = 0 THEN t + 5000000 WHEN t % 101 = 0 AND p IN (3, 5) THEN t - 2
             WHEN p = 0 THEN NULL WHEN p = 4 THEN t - 3 ELSE t - 1 END AS parent
      FROM (SELECT event_id AS e, event_id + 1 AS t, event_id % 6 AS p, ts, user_id,
              CASE WHEN (event_id // 6) % 10 = 9 THEN event_id // 6 - 1 ELSE event_id // 6 END AS s
            FROM events) WHERE e % 307 <> 306)
LEFT JOIN (SELECT CAST(event_id + 1 AS VARCHAR) AS kid, event_id + 1 AS kid_id,
             CASE WHEN (event_id + 1) % 89 = 0 THEN NULL WHEN (event_id + 1) % 97 = 0 THEN event_id + 5000001
                  WHEN (event_id + 1) % 101 = 0 AND event_id % 6 IN (3, 5) THEN event_id - 1
                  WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 4 THEN event_id - 2 ELSE event_id END AS kid_parent
           FROM events WHERE event_id % 307 <> 306) ON kid_parent = t
GROUP BY ALL
"""
