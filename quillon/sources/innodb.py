"""Binary tablespaces: 16 KiB pages, their headers and directory, and rows in a compact form.

The layout is a fixed one: a page's directory is the unsigned 16-bit numbers from
its end backwards, and every slot leads to a row of a 6-byte transaction id, a
7-byte roll pointer, a 4-byte unsigned integer and a text. Real tablespaces differ
(trailers, system records, primary keys first, flipped sign bits, long lengths),
so this isn't a reader for them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import take, text, unsigned

PAGE = 16_384
FIL_HEADER, PAGE_HEADER = 38, 94
#: Page types.
INDEX_PAGE, ALLOCATED_PAGE = 17_855, 0
#: Name, place and size of the header fields.
FIL_FIELDS = (("checksum", 0, 4), ("page_number", 4, 4), ("prev_page", 8, 4), ("next_page", 12, 4), ("lsn", 16, 8), ("page_type", 24, 2), ("flush_lsn", 26, 8), ("space_id", 34, 4))
PAGE_FIELDS = (("n_dir_slots", 38, 2), ("heap_top", 40, 2), ("n_recs", 54, 2))
RECORD_HEADER, TRANSACTION, ROLL, INTEGER = 5, 6, 7, 4


def fil_header(page: Column) -> Column:
    """The eight fields at a page's start; null for fewer than 38 bytes."""
    return F.when(F.length(page) >= FIL_HEADER, F.struct(*[unsigned(page, at, size).alias(name) for name, at, size in FIL_FIELDS]))


def page_header(page: Column) -> Column:
    """Slots, heap top and records; null for fewer than 94 bytes."""
    return F.when(F.length(page) >= PAGE_HEADER, F.struct(*[unsigned(page, at, size).alias(name) for name, at, size in PAGE_FIELDS]))


def directory(page: Column, slots: Column) -> Column:
    """Row places, slot 0 first: it is the page's last two bytes. No slots give an empty array."""
    numbers = F.when(slots > 0, F.sequence(F.lit(0), slots - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: unsigned(page, F.lit(PAGE - 2) - k * 2, 2))


def compact_row(page: Column, at: Column, n_nullable: int = 1, n_var: int = 1) -> Column:
    """transaction_id, roll_pointer, score and board of the row at a place.

    Before it stand the record header, the null bits (not read) and one length for
    each text column; the length with the lowest address is the text's.
    """
    body = at + TRANSACTION + ROLL
    lengths = at - RECORD_HEADER - (n_nullable + 7) // 8 - n_var
    board = text(take(page, body + INTEGER, unsigned(page, lengths, 1))) if n_var else F.lit(None).cast("string")
    return F.struct(take(page, at, TRANSACTION).alias("transaction_id"), take(page, at + TRANSACTION, ROLL).alias("roll_pointer"), unsigned(page, body, INTEGER).alias("score"), board.alias("board"))


def pages_of(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, page_no and page of every whole page of binary files; a file that ends inside a page is an error."""
    whole = F.length(content) % PAGE == 0
    checked = F.when(whole, F.col(content)).otherwise(F.raise_error(F.concat(F.lit("file ends inside a page: "), F.col(path))))
    count = (F.length(content) / PAGE).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    spread = files.select(path, checked.alias("_content"), F.explode(numbers).alias("page_no"))
    return spread.select(path, "page_no", F.substring("_content", F.col("page_no") * PAGE + 1, F.lit(PAGE)).alias("page"))


def rows_of(pages: DataFrame, n_nullable: int = 1, n_var: int = 1, index_only: bool = False) -> DataFrame:
    """path, page_no, slot and the decoded row of every directory slot."""
    kept = pages.where(unsigned(F.col("page"), 24, 2) == INDEX_PAGE) if index_only else pages
    slots = F.posexplode(directory(F.col("page"), unsigned(F.col("page"), 38, 2))).alias("slot", "place")
    spread = kept.select("path", "page_no", "page", slots)
    return spread.select("path", "page_no", "slot", "place", compact_row(F.col("page"), F.col("place"), n_nullable, n_var).alias("row")).select("path", "page_no", "slot", "place", "row.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of files of up to 2 GB each; larger ones are for the ``tablespace`` format."""
    return pages_of(spark.read.format("binaryFile").load(path))


class _Pages(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__(None)
        self.first, self.count = first, count


class TablespaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.each = int(options.get("pagesPerTask", "4096"))

    def _open(self):  # noqa: ANN202
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, path

    def partitions(self) -> list[InputPartition]:
        store, path = self._open()
        size = store.get_file_info(path).size
        if size is None:
            raise FileNotFoundError(self.path)
        if size % PAGE:
            raise OSError(f"file ends inside a page: {self.path}")
        pages = size // PAGE
        return [_Pages(at, min(self.each, pages - at)) for at in range(0, pages, self.each)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        store, path = self._open()
        with store.open_input_file(path) as f:
            f.seek(partition.first * PAGE)
            for k in range(partition.count):
                page = f.read(PAGE)
                if len(page) != PAGE:
                    raise OSError(f"file ends inside a page: {self.path}")
                yield self.path, partition.first + k, bytes(page)


class Tablespace(DataSource):
    """Format ``tablespace``: pages of one file of any size, read in ranges by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "tablespace"

    def schema(self) -> str:
        return "path string, page_no int, page binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TablespaceReader(self.options)


def read_tablespace(spark: SparkSession, path: str, pages_per_task: int = 4096) -> DataFrame:
    spark.dataSource.register(Tablespace)
    return spark.read.format("tablespace").option("pagesPerTask", str(pages_per_task)).load(path)


def page_bytes(score: Column, board: Column, fil: dict[str, Column] | None = None) -> Column:
    """A page with one row, as ``rows_of`` reads it; the board may have up to 255 bytes. ``fil`` are header fields other than 0."""
    number = lambda value, size: F.unhex(F.lpad(F.hex(value), 2 * size, "0"))
    zeros = lambda count: F.unhex(F.repeat(F.lit("00"), count))
    at = 120
    name = F.encode(board, "UTF-8")
    fields = {"page_type": F.lit(INDEX_PAGE)} | (fil or {})
    head = [*[number(fields.get(name, F.lit(0)), size) for name, _, size in FIL_FIELDS], number(F.lit(1), 2), zeros(F.lit(at - RECORD_HEADER - 2 - 40)), number(F.length(name), 1)]
    row = [zeros(F.lit(1 + RECORD_HEADER + TRANSACTION + ROLL)), number(score, INTEGER), name]
    return F.concat(*head, *row, zeros(F.lit(PAGE - 2 - at - TRANSACTION - ROLL - INTEGER) - F.length(name)), number(F.lit(at), 2))
