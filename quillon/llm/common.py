"""Scratch tables, size-checked joins and text helpers that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to this many bytes, by its measured size.
BROADCAST_BYTES = 16 << 20
#: Bytes of files for each part of a scratch table whose size is foreseen.
PART_BYTES = 4 << 20

_run = uuid.uuid4().hex[:12]
_roots: dict[str, SparkSession] = {}
_passing: ContextVar[list[Scratch] | None] = ContextVar("passing", default=None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: inside, they go by their places."""
    names = [f"c{k}" for k in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    plain = T.StructType([T.StructField(name, f.dataType) for name, f in zip(names, schema, strict=True)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)


def scratch_root(spark: SparkSession) -> str:
    """This run's folder under ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/quillon-scratch"
    root = f"{base.rstrip('/')}/quillon-{_run}"
    if root not in _roots:
        if not _roots:
            atexit.register(_drop_all)
        _roots[root] = spark
    return root


def _drop_all() -> None:
    for root, spark in _roots.items():
        try:
            drop_path(spark, root)
        except Exception:  # noqa: BLE001  the JVM may already be gone at exit
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """A table written to the shared folder: lineage ends here, and its size is known.

    ``like`` are tables that it is at most about as large as. It is then written
    in as many parts as their bytes call for, not one for each shuffle partition:
    many small files are slow to write, and to read in stores of objects.
    """

    def __init__(self, df: DataFrame, name: str, *like: Scratch):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        schema = df.schema
        if like:
            parts = -(-sum(t.bytes() for t in like) // PART_BYTES)
            df = df.coalesce(max(1, min(parts, shuffle_partitions(self.spark))))
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        if (passing := _passing.get()) is not None:
            passing.append(self)

    def drop(self) -> None:
        drop_path(self.spark, self.path)

    def bytes(self) -> int:
        if not hasattr(self, "_bytes"):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.path)
            self._bytes = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return self._bytes


@contextmanager
def in_passing() -> Iterator[list[Scratch]]:
    """Scratch tables written inside, in a list; those still in it are dropped at the end."""
    made: list[Scratch] = []
    token = _passing.set(made)
    try:
        yield made
    finally:
        _passing.reset(token)
        for table in made:
            table.drop()


def saved(df: DataFrame, name: str, *like: Scratch) -> DataFrame:
    return Scratch(df, name, *like).df


def sized(table: Scratch, expansion: int = 4) -> DataFrame:
    """The table with a broadcast hint while its measured size is within the bound, else as it is.

    ``expansion`` is how many times larger rows are in memory than in the files.
    """
    return F.broadcast(table.df) if table.bytes() * expansion <= BROADCAST_BYTES else table.df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of the batches, so that Python objects exist for few rows at a time.

    At the end, memory that is free goes back to the system: the worker lives on
    for other tasks, beside others and a JVM.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _libc_trim():  # noqa: ANN202
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return None


_trim = _libc_trim()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen most recently."""

    LIMIT, LONGEST = 150_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
