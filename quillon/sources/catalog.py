"""Tables of a session: CSV and Parquet files, and attached databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dsn import Dsn, lenient


def register_csv(spark: SparkSession, name: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A view over CSV files with a header line; types are inferred unless a schema is given.

    Inference reads the files once more, so give a schema for large ones.
    """
    reader = spark.read.options(header=True, **options)
    frame = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    frame.createOrReplaceTempView(name)
    return frame


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    frame = spark.read.parquet(path)
    frame.createOrReplaceTempView(name)
    return frame


def register_files(spark: SparkSession, name: str, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A view over files of any kind that Spark reads; give a schema for large ones whose kind has none of its own."""
    reader = spark.read.format(kind).options(**options)
    frame = (reader.schema(schema) if schema else reader).load(path)
    frame.createOrReplaceTempView(name)
    return frame


def write_files(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, **options: str) -> None:
    """The rows as files, in folders by the columns named, so that later reads skip folders."""
    writer = frame.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def quoted(driver: str, name: str) -> str:
    """An identifier as the database quotes it; a dot parts schema and table."""
    mark = "`" if driver == "mysql" else '"'
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


def jdbc_options(dsn: Dsn, **more: str) -> dict[str, str]:
    return {"url": dsn.jdbc_url} | dsn.jdbc_properties | more


def scan(spark: SparkSession, dsn: Dsn, table: str, **more: str) -> DataFrame:
    """All rows of a table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(dsn, dbtable=quoted(dsn.driver, table), **more)).load()


def query(spark: SparkSession, dsn: Dsn, text: str) -> DataFrame:
    """A query that the database runs itself."""
    return spark.read.format("jdbc").options(**jdbc_options(dsn, query=text)).load()


def ping(spark: SparkSession, dsn: Dsn) -> bool:
    """Whether the database answers."""
    return query(spark, dsn, "SELECT 1 AS one").count() == 1


def table_names(spark: SparkSession, dsn: Dsn) -> list[str]:
    where = "table_schema = DATABASE()" if dsn.driver == "mysql" else "table_schema = 'public'"
    rows = query(spark, dsn, f"SELECT table_name AS name FROM information_schema.tables WHERE {where}").collect()
    return sorted(r["name"] for r in rows)


def attach(spark: SparkSession, dsn: str | Dsn, tables: list[str] | None = None, **more: str) -> list[str]:
    """One lazy view for each table; filters and columns of later queries are pushed to the database."""
    found = lenient(dsn) if isinstance(dsn, str) else dsn
    names = table_names(spark, found) if tables is None else tables
    for name in names:
        scan(spark, found, name, **more).createOrReplaceTempView(name.split(".")[-1])
    return names
