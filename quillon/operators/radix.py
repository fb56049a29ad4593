"""A 64-bit hash finalizer in wrapping arithmetic, and radix partitions by its bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The finalizer's shift and multipliers (unsigned), and the radix.
SHIFT = 33
MULTIPLIERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
BITS = 8
PARTS = 1 << BITS


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def wrapping(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame whose integer arithmetic wraps; the mode is fixed when the frame is made."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        frame = make()
        frame.schema  # noqa: B018  analyses it
        return frame
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def mix(key: Column) -> Column:
    """The unsigned 32-bit hash of a 64-bit key, as a long; to be used inside ``wrapping``."""
    k = key.cast("long")
    for multiplier in MULTIPLIERS:
        k = k.bitwiseXOR(F.shiftrightunsigned(k, SHIFT)) * F.lit(_signed(multiplier)).cast("long")
    k = k.bitwiseXOR(F.shiftrightunsigned(k, SHIFT))
    return k.bitwiseXOR(F.shiftrightunsigned(k, 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def mix_int(key: int) -> int:
    """The same for one key in Python."""
    full = (1 << 64) - 1
    k = key & full
    for multiplier in MULTIPLIERS:
        k = (k ^ k >> SHIFT) * multiplier & full
    k ^= k >> SHIFT
    return (k ^ k >> 32) & 0xFFFFFFFF


def radix(key: Column, level: int = 0) -> Column:
    """The byte of the hash that a partitioning level goes by."""
    return F.shiftright(mix(key), BITS * level).bitwiseAND(F.lit(PARTS - 1).cast("long")).cast("int")


def with_radix(frame: DataFrame, key: str, level: int = 0) -> DataFrame:
    """The rows with ``radix``; null keys have none."""
    return wrapping(frame.sparkSession, lambda: frame.withColumn("radix", radix(F.col(key), level)))


def radix_counts(frame: DataFrame, key: str, level: int = 0) -> DataFrame:
    """Rows in each radix partition."""
    return with_radix(frame, key, level).groupBy("radix").agg(F.count("*").alias("n"))


def radix_partition(frame: DataFrame, key: str, level: int = 0) -> DataFrame:
    """The rows dealt so that each partition of the radix is in one task."""
    return with_radix(frame, key, level).repartition(PARTS, "radix")
