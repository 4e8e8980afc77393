"""Exact dedup by two-pass Bloom filtering.

Pass one builds a blocked Bloom filter that counts to two: each digest sets three bits of
one 64-bit word, and a bit is remembered as set once or set by more than one row. A row
whose three bits were all set more than once may be repeated; every other row is certainly
alone. Pass two shuffles only the rows that may be repeated, by their SHA-256 digest, and
the rest pass straight through. Texts never shuffle: only ids, lengths and digests do.

The filter is as large as the corpus wants (``bits_per_row``) and travels in blocks of fixed size, each a
range of hashes. The digests lie sorted by hash within each task's file, so that the narrow pass of a
block skips the Parquet pages outside its range: in files of many pages all but its share, in files of few pages little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, arrow_schema, as_batches, column, text_of, tune

#: Of a task's rows so many are combined at a time.
_ROWS = 1 << 20
_MOST_WORDS = (1 << 31) - 1


def combined(word: np.ndarray, once: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, with the bits that any of its rows set once, and those that a row set more than once or several rows set."""
    order = np.argsort(word, kind="stable")
    word, once, more = word[order], once[order], more[order]
    head = np.ones(len(word), bool)
    head[1:] = word[1:] != word[:-1]
    start = np.flatnonzero(head)
    longest = int(np.diff(np.append(start, len(word))).max(initial=1))
    so_far, k = once.copy(), 1  # the bits of this row and those before it, by doubling
    while k < longest:
        so_far[k:] |= np.where(word[k:] == word[:-k], so_far[:-k], 0)
        k *= 2
    before = np.zeros_like(so_far)
    before[1:] = np.where(head[1:], 0, so_far[:-1])
    return word[start], so_far[np.append(start[1:], len(word)) - 1], np.bitwise_or.reduceat(more | (once & before), start)


def repeated_bits(rows: DataFrame) -> DataFrame:
    """(word, bits) of the filter: bits that more than one row set. rows: word, mask (long).

    A task sends a row for each of its words, however often its digests repeat; the rows of a word are merged one by one.
    """
    target, arrow = arrow_schema(rows.sparkSession, "word long, once long, more long")
    result, bits = arrow_schema(rows.sparkSession, "word long, bits long")
    numbers = lambda b: [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]

    def partial(batches):
        held, size = [], 0
        for b in batches:
            word, mask = numbers(b)
            held.append((word, mask, np.zeros_like(mask)))
            size += b.num_rows
            if size >= _ROWS:
                held = [combined(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > _ROWS // 2:
                    yield from as_batches(dict(zip(("word", "once", "more"), held[0])), arrow)
                    held = []
                size = sum(len(h[0]) for h in held)
        if size:
            yield from as_batches(dict(zip(("word", "once", "more"), combined(*map(np.concatenate, zip(*held))))), arrow)

    def merge(batches):
        last = None  # of the last word there may be more to come
        for b in batches:
            if b.num_rows:
                new = numbers(b)
                word, once, more = combined(*(new if last is None else map(np.concatenate, zip(last, new))))
                last = word[-1:], once[-1:], more[-1:]
                some = np.flatnonzero(more[:-1])
                yield from as_batches({"word": word[some], "bits": more[some]}, bits)
        if last is not None and last[2][0]:
            yield from as_batches({"word": last[0], "bits": last[2]}, bits)

    parts = rows.select("word", "mask").mapInArrow(partial, target)
    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(merge, result)


def probed(scratch: Scratch, digests: DataFrame, words: int, block_bytes: int) -> DataFrame:
    """doc_id, n, h, maybe: whether a digest's bits were all set more than once. digests: doc_id, n, h, p, mask, sorted by p within files."""
    spark = digests.sparkSession
    bits = scratch.write(repeated_bits(digests.select(_word(words).alias("word"), "mask")).sortWithinPartitions("word"), "filter")
    blocks = max(1, -(-words * 8 // block_bytes))
    kind = digests.schema["doc_id"].dataType.simpleString()
    target, arrow = arrow_schema(spark, f"doc_id {kind}, n long, h binary, maybe boolean")
    out = None
    for k in range(blocks):
        low, high = k * (1 << 32) // blocks, (k + 1) * (1 << 32) // blocks
        first, last = low * words >> 32, (high - 1) * words >> 32
        some = bits.where(F.col("word").between(first, last)).toArrow()
        block = np.zeros(last - first + 1, np.int64)
        block[some.column("word").to_numpy() - first] = some.column("bits").to_numpy()
        sent = spark.sparkContext.broadcast(block)

        def probe(batches, sent=sent, first=first):
            for b in batches:
                if b.num_rows:
                    word, mask = (b.column(j).to_numpy(zero_copy_only=False) for j in (3, 4))
                    maybe = sent.value[word - first] & mask == mask
                    yield from as_batches({"doc_id": b.column(0), "n": b.column(1), "h": b.column(2), "maybe": pa.array(maybe)}, arrow)

        mine = digests.where((F.col("p") >= low) & (F.col("p") < high)).select("doc_id", "n", "h", _word(words).alias("word"), "mask")
        part = mine.mapInArrow(probe, target)
        out = part if out is None else out.unionByName(part)
    return scratch.write(out, "probed")


def _word(words: int) -> Column:
    """The filter word of a digest: the higher the hash, the higher the word."""
    return F.shiftright(F.col("p") * words, 32)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, block_bytes: int = 64 << 20
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; of equal texts the one with the
    most code points stays, then the smallest id. A null text counts as empty, so null, empty
    and blank texts are equal. A null id sorts after all others. Rows that repeat an id are
    each a member of their group; of rows that tie in length and id, all are ``kept``.
    An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "exact")
    text = text_of(text_col)
    hashed = docs.select(
        column(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n"),
        F.unhex(F.sha2(F.translate(text, ASCII_SPACE, ""), 256)).alias("h"),
    ).withColumn("x", F.xxhash64("h"))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x, {k}) & 63 as int))")
    digests = scratch.write(
        hashed.withColumn("p", F.shiftrightunsigned("x", 32))
        .withColumn("mask", bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)))
        .drop("x")
        .sortWithinPartitions("p"),
        "digests",
    )
    words = min(_MOST_WORDS, max(1, digests.count() * bits_per_row // 64))
    rows = probed(scratch, digests, words, block_bytes)
    scratch.drop(digests)
    alone = rows.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "h"
    )
    maybe = rows.where("maybe").select("doc_id", "n", "h")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id")))
    groups = scratch.write(maybe.groupBy("h").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = maybe.join(groups, "h").select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((F.col("n") == -F.col("best.n")) & F.col("doc_id").eqNullSafe(F.col("best.id"))).alias("kept"),
        "h",
    )
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
