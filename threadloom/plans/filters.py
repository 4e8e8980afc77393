"""Exact filters that travel to the rows: the keys asked for as packed bitmaps by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch

#: Of one range's bitmap, and of all that are sent to every executor, at most; more keys meet the rows by a shuffle.
RANGE_BYTES, MOST_BYTES = 4096, 64 << 20


def _bit(position: Column, bitmap: Column) -> Column:
    """Whether the bit is set; of no bitmap none is."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (position % 8 + 1).cast("int"))
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def marked(rows: DataFrame, key: str, keys: DataFrame, name: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with a boolean column ``name``: whether ``key`` is among ``keys`` (one column of longs, repeats allowed).

    Bitmaps of 32768 keys each go to the rows while they take ``most_bytes`` at most, so that no row moves; beyond
    that rows and keys are joined. Null keys are among none.
    """
    k = F.col(keys.columns[0])
    packed = keys.where(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("_range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("_bits"))
    packed = Scratch(rows.sparkSession, "keys").write(packed, "bitmaps")
    if packed.count() * RANGE_BYTES > most_bytes:
        there = keys.select(k.alias(key)).distinct().withColumn(name, F.lit(True))
        return rows.join(there, key, "left").select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))
    at = rows.withColumn("_range", F.bitmap_bucket_number(F.col(key))).join(F.broadcast(packed), "_range", "left")
    return at.select(*rows.columns, _bit(F.bitmap_bit_position(F.col(key)), F.col("_bits")).alias(name))
