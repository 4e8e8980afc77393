"""Quality selection by importance resampling over hashed n-gram models.

Two bag-of-n-grams models (hashed words and word pairs) are counted over all documents: one
over the target documents, one over the raw corpus. A document's weight is the log ratio of
its likelihoods, and Gumbel top-k draws k documents without replacement in proportion to the
weights. The noise is a hash of the id, so a rerun draws the same documents.

The number of buckets grows as the square root of the corpus, about as its vocabulary does, so that rare wording counts in a
large one too, while each bucket holds ever more n-grams. 100 TB of text have 4.5 million buckets, a table of 36 MB; a
table never exceeds MOST_BUCKETS, 64 MB, which 350 TB reach.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, split_by, text_of, tune

BUCKETS = 10_000  # at least
MOST_BUCKETS = 1 << 23  # of the table that travels to the tasks
BYTES_A_BUCKET = 50_000  # of text, about 17,000 words and pairs, in a corpus for which BUCKETS are enough
_CACHE_WORDS = 250_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Hashes(dict):
    """Word to 64-bit hash; beyond ``_CACHE_WORDS`` words nothing more is kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = h
        return h


_hashes = _Hashes()  # of this worker process


def bucket_count(texts: DataFrame) -> int:
    """Buckets for a corpus: as the square root of its bytes, BUCKETS at least and MOST_BUCKETS at most."""
    size = texts.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, math.ceil(math.sqrt(BUCKETS * size / BYTES_A_BUCKET))))


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) ^ (h[:-1] >> np.uint64(29))
    return np.concatenate([h, pairs]) % np.uint64(buckets)


def gram_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n (raw), n_target over all texts. texts: text, target (boolean). A task sends ``buckets`` rows at most."""
    target, arrow = arrow_schema(texts.sparkSession, "bucket int, n long, n_target long")

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for wanted in (False, True):
                mine = b.column(0).filter(b.column(1) if wanted else pc.invert(b.column(1)))
                got = [gram_buckets(text, buckets) for text in mine.to_pylist()]
                if got:
                    n = np.bincount(np.concatenate(got).astype(np.int64), minlength=buckets)
                    total[0] += n
                    if wanted:
                        total[1] += n
        at = np.flatnonzero(total[0])
        yield from as_batches({"bucket": at.astype(np.int32), "n": total[0][at], "n_target": total[1][at]}, arrow)

    parts = texts.mapInArrow(run, target)
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def log_ratio(counts: pa.Table, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    n = np.full((2, buckets), smoothing)
    at = counts.column("bucket").to_numpy()
    n[0, at] += counts.column("n").to_numpy()
    n[1, at] += counts.column("n_target").to_numpy()
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float | None:
    """The k-th largest ``key`` by ever finer histograms; nothing but counts and a few keys reaches the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return None
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        inside = keys.where(F.col("key").between(low, high))
        rows = inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("l"), F.max("key").alias("h"))
        for r in sorted(rows.collect(), key=lambda r: -r.b):  # at most `bins` rows
            if k <= r.n:
                low, high = r.l, r.h
                break
            k -= r.n
    return low


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    fraction: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    buckets: int | None = None,
    temperature: float = 1.0,
) -> DataFrame:
    """One row per input row: doc_id, log_weight, gumbel_key, kept.

    Target documents are those labelled quality 1 and not toxic. ``kept`` marks the
    ceil(fraction x rows) largest keys; None takes the share of target documents among the
    labelled ones. Rows whose keys tie at the limit are all kept. Null and empty texts have
    weight 0. Without labels both models are equal, every weight is 0 and the draw is uniform.
    ``buckets`` is the size of the models' tables; None takes ``bucket_count`` of the texts.
    Weights add up over a text's words, so that long documents differ more than the noise reaches; a
    ``temperature`` above 1 divides them and gives the draw more room. Labels that repeat an id count as target if
    any of them is. Rows that repeat an id share their noise, and so do rows without one whose texts are equal. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "importance")
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))
    wanted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(good).alias("target"))
    narrow = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if fraction is None:
        share = wanted.agg(F.avg(F.col("target").cast("double"))).first()[0]
        fraction = 0.5 if share is None else share
    wanted = scratch.write(wanted.where("target"), "wanted")
    # texts that are certainly not target don't shuffle
    plain, maybe = split_by(narrow, F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("h")))
    marked = plain.withColumn("target", F.lit(False)).unionByName(maybe.join(wanted, "doc_id", "left"))
    buckets = buckets or bucket_count(narrow)
    counts = gram_counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), buckets)
    ratio = spark.sparkContext.broadcast(log_ratio(counts.toArrow(), buckets))  # a row for each bucket
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    seeded = narrow.withColumn("seed", own)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    target, arrow = arrow_schema(spark, f"doc_id {kind}, seed long, log_weight double")

    def weigh(batches):
        for b in batches:
            if b.num_rows:
                w = [float(ratio.value[gram_buckets(t, buckets)].sum()) for t in b.column(1).to_pylist()]
                yield from as_batches({"doc_id": b.column(0), "seed": b.column(2), "log_weight": w}, arrow)

    unit = (F.shiftrightunsigned("seed", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = scratch.write(
        seeded.mapInArrow(weigh, target).select("doc_id", "log_weight", (F.col("log_weight") / temperature - F.log(-F.log(unit))).alias("gumbel_key")),
        "keys",
    )
    k = math.ceil(fraction * keyed.count())
    limit = kth_largest(keyed.select(F.col("gumbel_key").alias("key")), k) if k else math.inf
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(math.inf if limit is None else limit))

