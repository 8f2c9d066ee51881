"""Leaving rows out before a shuffle that a join on a key would drop after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK_BITS = 4096 * 8  # the size of Spark's bitmaps
#: Bits per key, so that about one in sixteen of the other rows stays, and the most blocks (64 MB) of a bitmap.
BITS_PER_KEY, MOST_BLOCKS = 16, 16_384


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows whose ``key`` occurs in ``keys`` and a few others; rows without a key are left out.

    The hashes of the keys set bits of a bitmap that is broadcast in blocks, so a row is judged where it lies.
    Where there are more keys than the largest bitmap has room for, more of the other rows stay. ``keys`` is read twice.
    """
    blocks = min(MOST_BLOCKS, keys.count() * BITS_PER_KEY // _BLOCK_BITS + 1)
    bit = F.pmod(F.xxhash64(key), F.lit(blocks * _BLOCK_BITS))
    block, at = F.floor(bit / _BLOCK_BITS), F.pmod(bit, F.lit(_BLOCK_BITS))
    bitmap = (
        keys.where(F.col(key).isNotNull()).groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(at).alias("_bitmap"))
    )
    return (
        rows.where(F.col(key).isNotNull())
        .withColumns({"_block": block, "_at": at.cast("int")})
        .join(F.broadcast(bitmap), "_block")
        .where(_has_bit(F.col("_bitmap"), F.col("_at")))
        .drop("_block", "_at", "_bitmap")
    )


def _has_bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1
