"""The engine's session: tables by name, SQL over them, and the settings that suit analytic queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.frontend import StatementError, summarize
from .sources import catalog
from .sources import dsn as dsns

#: Settings that a new session starts with; what the caller or the cluster sets comes first.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


class Engine:
    """Named tables and SQL over one Spark session."""

    def __init__(self, spark: SparkSession | None = None, **settings: str):
        if spark is None:
            builder = SparkSession.builder.appName("quillon")
            for key, value in (DEFAULTS | settings).items():
                builder = builder.config(key, value)
            spark = builder.getOrCreate()
        self.spark = spark

    def register_csv(self, name: str, path: str, **options: str) -> DataFrame:
        return catalog.register_csv(self.spark, name, path, **options)

    def register_parquet(self, name: str, path: str) -> DataFrame:
        return catalog.register_parquet(self.spark, name, path)

    def register_files(self, name: str, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
        """A view over files of a kind that Spark reads: orc, json, avro, text and others."""
        return catalog.register_files(self.spark, name, path, kind, schema, **options)

    def write(self, text: str, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, **options: str) -> None:
        """Writes a query's rows to files, in folders by the columns named."""
        catalog.write_files(self.sql(text), path, kind, mode, by, **options)

    def attach(self, dsn: str, tables: list[str] | None = None, **options: str) -> list[str]:
        """Makes a lazy view for every table of a database, or for those named."""
        return catalog.attach(self.spark, dsn, tables, **options)

    def connect(self, dsn: dsns.Dsn) -> list[str]:
        """Attaches a database that has answered."""
        if not catalog.ping(self.spark, dsn):
            raise ConnectionError(f"no answer from {dsn.host}")
        return catalog.attach(self.spark, dsn)

    def register_function(self, name: str, function: Callable[..., object], returns: str) -> None:
        """A function that SQL can call: on whole pandas series, batch by batch, not row by row."""
        self.spark.udf.register(name, F.pandas_udf(function, returns))

    def register_aggregate(self, name: str, function: Callable[..., object], returns: str) -> None:
        """An aggregate that SQL can call: from a group's whole series to one value."""
        self.spark.udf.register(name, F.pandas_udf(function, returns, F.PandasUDFType.GROUPED_AGG))

    def register_table_function(self, name: str, kind: type, returns: str) -> None:
        """A table function that SQL can call: a class whose ``eval`` yields rows."""
        self.spark.udtf.register(name, F.udtf(kind, returnType=returns))

    def persist(self, name: str) -> DataFrame:
        """Keeps a table's rows in memory, on disk where memory ends, from its next use on."""
        return self.spark.table(name).persist(StorageLevel.MEMORY_AND_DISK)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def sql(self, text: str) -> DataFrame:
        """A lazy frame for one query.

        INSERT, UPDATE and DELETE are refused: views over files and databases
        can't be changed from here.
        """
        try:
            kind = summarize(self.spark, text).query_type
        except StatementError:
            kind = "OTHER"
        if kind in ("INSERT", "UPDATE", "DELETE"):
            raise StatementError(f"{kind} is not supported: attached tables are read-only")
        return self.spark.sql(text)
