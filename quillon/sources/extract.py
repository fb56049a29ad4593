"""Database tables to Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, dsn


def extract_tables(spark: SparkSession, source: str, tables: list[str], out: str, read: Callable[[str], DataFrame] | None = None) -> dict[str, int]:
    """Writes each table to ``out``/<table>.parquet and returns the rows of each; the first error ends it.

    ``read`` gives a table's frame, by default from the database.
    """
    if read is None:
        found = dsn.strict(source)
        read = lambda name: catalog.scan(spark, found, name)
    counts = {}
    for name in tables:
        path = f"{out.rstrip('/')}/{name}.parquet"
        read(name).write.mode("overwrite").parquet(path)
        counts[name] = spark.read.parquet(path).count()
    return counts
