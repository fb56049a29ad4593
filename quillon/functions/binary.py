"""Columns from bytes: big-endian integers and UTF-8 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {1: "int", 2: "int", 3: "int", 4: "long", 5: "long", 6: "long", 7: "long", 8: "decimal(20,0)"}


def take(data: Column, at: Column | int, size: Column | int) -> Column:
    """``size`` bytes from a place counted from 0."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, start + 1, F.lit(size) if isinstance(size, int) else size)


def unsigned(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned big-endian integer of 1 to 8 bytes; null where the bytes end before it."""
    part = take(data, at, size)
    number = F.conv(F.hex(part), 16, 10).cast(_TYPES[size])
    return F.when(F.length(part) == size, number)


def text(data: Column) -> Column:
    """Bytes as UTF-8."""
    return F.decode(data, "UTF-8")
