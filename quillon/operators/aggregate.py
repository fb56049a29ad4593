"""One-pass sum, minimum and maximum of doubles with identities instead of nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def sum_min_max(column: str | Column) -> tuple[Column, Column, Column]:
    """Aggregates: the sum from 0.0, the minimum from +inf, the maximum from -inf.

    No rows give (0.0, +inf, -inf). A NaN makes the sum NaN, but is neither
    minimum nor maximum. Nulls are passed over.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    number = F.when(~F.isnan(x), x)
    return F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.min(number), F.lit(INFINITY)), F.coalesce(F.max(number), F.lit(-INFINITY))


def aggregate_f64(frame: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """sum, min and max of a column, of all rows or of each group."""
    total, low, high = sum_min_max(column)
    return frame.groupBy(*(by or [])).agg(total.alias("sum"), low.alias("min"), high.alias("max"))


def total_f64(column: str | Column) -> Column:
    """The sum alone, 0.0 for no rows."""
    return sum_min_max(column)[0]
