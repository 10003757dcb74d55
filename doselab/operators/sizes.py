"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that mark a row which others are to meet, and bitmaps of marks (4 KB each) at most.
MARK_BITS, MARK_BITMAPS = 8, 8192

#: A side is broadcast only when it has at most so many rows of a few short columns; otherwise it is shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads at most limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is checked to be small."""
    return F.broadcast(df) if small(df, limit) else df


def marked(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key side does not hold, before they are shuffled to meet it; none that it holds goes.

    Marks are a table of MARK_BITS bits a row of side, which is read twice, in bitmaps of 4 KB, of which up to MARK_BITMAPS are broadcast.
    """
    bits = min(MARK_BITMAPS << 15, max(1, side.count()) * MARK_BITS)
    place = F.pmod(F.xxhash64(key), F.lit(bits).cast("bigint"))
    marks = side.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    met = rows.withColumn("_place", place).join(F.broadcast(marks), F.bitmap_bucket_number("_place") == F.col("_bucket"))
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)
