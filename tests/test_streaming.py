"""Pairs and counts on streams against the batch operators."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import pairs
from threadloom.operators.typed import typed
from threadloom.plans.staging import Scratch
from threadloom.sources import messages
from threadloom.streaming.labelling import label_counts
from threadloom.streaming.pairing import pair_stream

from .conftest import SF

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def _run(spark, df, path, name):
    q = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.read.parquet(f"{path}/{name}")


def test_pairs(rocks, tmp_path):
    """Messages in three files out of order, repeated, and some far too late, give the pairs of the batch."""
    spark = rocks
    t = Scratch(spark, "t").write(typed(messages.read(spark, SF)).withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))))
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in range(3):
        t.where((part == k) | (F.col("id") % 20 == 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = t.where("id = 1").select(F.lit(777_777).cast("long").alias("id"), "parent", "inbound", "author", "created_at", "text", "clean", F.timestamp_seconds(F.lit(1_600_000_000)).alias("time"))
    reply = t.where("not inbound").limit(1).withColumn("id", F.lit(777_778).cast("long")).withColumn("parent", F.lit(777_777).cast("long"))
    old.unionByName(reply).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = _run(spark, pair_stream(stream, messages.BRANDS), tmp_path, "pairs").select("id", "parent", "brand", "text", "p_text", "p_author")
    want = pairs.outcomes(t, pairs.brand_replies(t, messages.BRANDS)).where("outcome = 'candidate'").select("id", "parent", "brand", "text", "p_text", "p_author")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_waiting_ends(rocks, tmp_path):
    """After its time a message is forgotten; until then a reply finds it, and a reply that came first waits for it."""
    spark = rocks
    schema = "id long, parent long, inbound boolean, author string, created_at string, text string, clean string, time timestamp"
    files = [
        [(1, 0, True, "c", "q1", 0), (12, 2, False, "Brand00", "early", 5)],
        [(2, 0, True, "c", "q2", 50), (11, 1, False, "brand00", "in time", 60)],
        [(90, 0, True, "c", "far on", 9000)],
        [(91, 0, True, "c", "farther on", 9100)],
        [(13, 1, False, "Brand00", "too late", 9200), (14, 90, False, "Brand00", "answer", 9201), (15, 0, False, "Brand00", "no parent", 9202)],
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(*r[:4], "", r[4], r[4], r[5]) for r in rows], "id long, parent long, inbound boolean, author string, created_at string, text string, clean string, s long")
        df.withColumn("time", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = _run(spark, pair_stream(stream, ["Brand00"], "10 seconds", 600), tmp_path, "pairs")
    assert sorted((r.id, r.parent, r.p_text) for r in got.collect()) == [(11, 1, "q1"), (12, 2, "q2"), (14, 90, "far on")]


def test_label_counts(spark, tmp_path):
    """Windows are counted once the watermark has passed them; messages behind it are left out."""
    rows = [[("my delivery has not arrived", 0), ("refund please", 10)], [("my delivery is late", 20), ("hello", 9000)], [("hello", 9100)], [("my delivery is late", 30), ("hello", 20000)]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "text string, s long").select("text", F.timestamp_seconds(F.col("s") + 1_699_999_200).alias("time"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("text string, time timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = _run(spark, label_counts(stream, "time"), tmp_path, "counts").collect()
    first = {r.agent_intent: r.n for r in got if r.window.start.timestamp() == 1_699_999_200}
    assert first["delivery_issue"] == 2 and sum(first.values()) == 3
