"""Text and intent functions on literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import intents as I
from threadloom.functions import text as X
from threadloom.functions import values as V
from threadloom.operators import labels


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_vocabularies():
    assert set(V.AGENT_ORDER) == set(V.TAXONOMY_ORDER) == set(V.LABELS)
    assert set(V.STRONG_PHRASES) <= set(V.TAXONOMY_ORDER)
    assert abs(sum(V.WEIGHTS.values()) - 1) < 1e-9


@pytest.mark.parametrize(
    "value, want",
    [(None, ""), ("", ""), ("  a \t\n b ", "a b"), ("a b", "a b"), ("\x1ca\x85b", "a b")],
)
def test_normalize(spark, value, want):
    assert one(spark, value, X.normalize) == want


@pytest.mark.parametrize(
    "value, want",
    [
        (None, ""),
        ("@Übung x", "x"),
        ("@shop Look HTTPS://x.y/z now", "look now"),
        ("t.co/abc hi", "hi"),
        ("@only", ""),
    ],
)
def test_clean(spark, value, want):
    assert one(spark, value, X.clean) == want


def test_word_count(spark):
    assert one(spark, "", lambda c: X.words(X.clean(c))) == 0
    assert one(spark, "@a b  c", lambda c: X.words(X.clean(c))) == 2


def test_redact(spark):
    r = one(spark, "@shop order 123456789, call 07123 456789 or a@b.com see https://x.y @12345 n 99999", X.redact)
    assert (r.url, r.email, r.phone, r.number) == (1, 1, 1, 2)
    assert r.text == "@shop order [NUM], call [PHONE] or [EMAIL] see [URL] @12345 n [NUM]"


def test_generic_reply(spark):
    s = one(spark, "@1 Please DM us", lambda c: X.reply_signals(c, X.clean(c)))
    assert s.is_generic and s.has_redirect and s.is_short and not s.has_actionable and s.signals == 3
    s = one(spark, "@1 ", lambda c: X.reply_signals(c, X.clean(c)))
    assert not s.valid and not s.is_generic


def test_capped(spark):
    assert one(spark, "x" * 300, X.example_text) == "x" * 239 + "…"
    assert one(spark, "x" * 239 + " yz", X.example_text) == "x" * 239 + "…"


@pytest.mark.parametrize("value, want", [("Mon Jan 01 00:00:07 +0000 2024", "2024-01-01T00:00:07+00:00"), ("bad date", ""), (None, "")])
def test_created(spark, value, want):
    assert one(spark, value, lambda c: X.iso(X.created(c))) == want


@pytest.mark.parametrize(
    "message, intent, points, review",
    [
        ("My delivery has not arrived", "delivery_issue", 88, True),
        ("half my items were missing from my order", "missing_or_incorrect_item", None, True),
        ("I was charged twice for my order", "refund_or_payment", None, True),
        ("my clubcard points are missing", "clubcard_or_loyalty", None, None),
        ("is the gluten free bread back in stock", "product_availability", None, False),
        ("huge queue at the till in your store", "store_experience", None, None),
        ("asdfghjkl qwerty zzz", V.OTHER, 30, True),
        ("I cannot log into my account", "account_or_technical_issue", None, None),
        ("I want to speak to a human", None, None, True),
        ("I will take legal action", None, None, True),
        ("please refund the duplicate charge", "refund_or_payment", None, True),
        ("Is bread available?", "product_availability", None, False),
        ("This item is unavailable", "product_availability", None, False),
        ("élate", V.OTHER, 30, True),
    ],
)
def test_labels(spark, message, intent, points, review):
    df = spark.createDataFrame([(message,)], "text string").withColumn("clean", X.clean("text"))
    r = labels.assess(labels.label(df)).first()
    assert intent is None or r.agent_intent == intent
    assert points is None or r.points == points
    assert review is None or r.needs_review == review


def test_quirks(spark):
    hit = lambda t: one(spark, t, I.matched)
    assert hit("it was substituted") == []  # a stem is no word
    assert "refund_or_payment" not in hit("i was charged")
    assert hit("checkout") == ["online_order_issue", "store_experience"]
    df = spark.createDataFrame([("as a courtesy",)], "text string").withColumn("clean", X.clean("text"))
    assert labels.assess(labels.label(df)).first().escalation == "legal"


def test_json_keeps_nulls(spark):
    got = spark.range(1).select(F.to_json(F.struct(F.lit(None).cast("string").alias("a")), {"ignoreNullFields": "false"}).alias("j")).first().j
    assert json.loads(got) == {"a": None}
