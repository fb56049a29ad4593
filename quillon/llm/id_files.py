"""Token-ID files in patched frame-of-reference blocks.

File layout (little-endian):

    magic "QPF1", block size u32, ids u64, documents u64, blocks u64
    blocks: minimum u32, exceptions u16, width u8, zero u8,
            packed low bits of (id - minimum), exception places u16, exception values u32
    index: start of every block u64
    documents: ids u64 each, doc_id i64 each, doc_id-is-null u8 each
    footer: start of the index u64, crc32 of all before it u32, magic

A block's width is the number of bits that a given share of its values needs;
the values that need more are exceptions, stored whole.

Defined results: a null text is an empty document (its end id alone); rows with
a null doc_id come first; rows of one doc_id follow one another in the order of
a hash of their texts; other columns are ignored; an empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, new_path, read_table, saved, shuffle_partitions, slices
from .token_ids import encoder, tokenizer_path

MAGIC, HEAD, BLOCK, FOOT = b"QPF1", struct.Struct("<4sIQQQ"), struct.Struct("<IHBB"), struct.Struct("<QI4s")


def _word(width: int) -> np.dtype:
    """The narrowest unsigned type of at least ``width`` bits."""
    return np.dtype("<u1" if width <= 8 else "<u2" if width <= 16 else "<u4")


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes, ``width`` bits a value."""
    word = _word(width)
    raw = np.ascontiguousarray(values.astype(word)).view(np.uint8).reshape(len(values), -1)
    if width == 8 * word.itemsize:
        return raw
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(*values.shape, 8 * word.itemsize)
    return np.packbits(bits[..., :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack_bits(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    word = _word(width)
    if width == 8 * word.itemsize:
        return packed.view(word).astype("<u4")
    bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little").reshape(len(packed), count, width)
    full = np.zeros((len(packed), count, 8 * word.itemsize), np.uint8)
    full[..., :width] = bits
    return np.packbits(full, axis=-1, bitorder="little").reshape(len(packed), -1).view(word).astype("<u4")


def _widths(above: np.ndarray, share: float) -> np.ndarray:
    """Bits that ``share`` of each row's values need."""
    k = min(above.shape[1] - 1, int(np.ceil(share * above.shape[1])) - 1)
    at = np.partition(above, k, axis=1)[:, k]
    return np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, size: int = 1024, share: float = 0.98) -> tuple[list[bytes], np.ndarray]:
    """The blocks of the ids, and the length of each in bytes."""
    blocks: list[bytes] = []
    for at in range(0, len(ids), size * 512):
        part = ids[at : at + size * 512]
        for rows in (part[: len(part) // size * size].reshape(-1, size), part[len(part) // size * size :].reshape(1, -1)):
            if not rows.size:
                continue
            low = rows.min(axis=1)
            above = rows - low[:, None]
            widths = _widths(above, share)
            out: list[bytes] = [b""] * len(rows)
            for width in np.unique(widths):
                which = np.flatnonzero(widths == width)
                packed = _pack_bits(above[which], int(width))
                over = above[which] >> np.uint32(width) if width < 32 else np.zeros_like(above[which])
                for k, row in enumerate(which):
                    places = np.flatnonzero(over[k])
                    out[row] = b"".join((BLOCK.pack(int(low[row]), len(places), int(width), 0), packed[k].tobytes(), places.astype("<u2").tobytes(), above[row][places].astype("<u4").tobytes()))
            blocks += out
    return blocks, np.fromiter(map(len, blocks), np.int64, len(blocks))


def decode_blocks(data: bytes, starts: np.ndarray, count: int, size: int) -> np.ndarray:
    """The ids of all blocks, from their starts."""
    out = np.empty(count, "<u4")
    heads = [BLOCK.unpack_from(data, s) for s in starts.tolist()]
    of: dict[tuple[int, int], list[int]] = {}
    for k, (_, _, width, _) in enumerate(heads):
        of.setdefault((width, min(size, count - k * size)), []).append(k)
    for (width, n), all_rows in of.items():
        length = (width * n + 7) // 8
        for at in range(0, len(all_rows), 512):
            rows = all_rows[at : at + 512]
            if width:
                packed = np.frombuffer(b"".join([data[(s := int(starts[k]) + BLOCK.size) : s + length] for k in rows]), np.uint8).reshape(len(rows), length)
                values = _unpack_bits(packed, width, n)
            else:
                values = np.zeros((len(rows), n), "<u4")
            for k, row in zip(rows, values, strict=True):
                low, patched, _, _ = heads[k]
                if patched:
                    s = int(starts[k]) + BLOCK.size + length
                    row[np.frombuffer(data, "<u2", patched, s)] = np.frombuffer(data, "<u4", patched, s + 2 * patched)
                out[k * size : k * size + n] = row + np.uint32(low)
    return out


def encode_file(ids: np.ndarray, lengths: list[int], doc_ids: list[int | None], size: int = 1024, share: float = 0.98) -> bytes:
    if not 1 <= size <= 65_535:
        raise ValueError("exception places take 16 bits")
    blocks, each = encode_blocks(ids, size, share)
    starts = HEAD.size + np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
    body = b"".join((
        HEAD.pack(MAGIC, size, len(ids), len(lengths), len(blocks)),
        *blocks,
        starts[:-1].astype("<u8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
    ))
    return body + FOOT.pack(int(starts[-1]), zlib.crc32(body), MAGIC)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Ids of all documents, ids in each, and their doc_ids."""
    index, crc, magic = FOOT.unpack_from(data, len(data) - FOOT.size)
    first, size, count, docs, blocks = HEAD.unpack_from(data)
    if magic != MAGIC or first != MAGIC or zlib.crc32(memoryview(data)[: -FOOT.size]) != crc:
        raise ValueError("not a whole token-id file")
    starts = np.frombuffer(data, "<u8", blocks, index)
    at = index + 8 * blocks
    lengths = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    doc_ids = np.frombuffer(data, "<i8", docs, at + 8 * docs).tolist()
    nulls = np.frombuffer(data, np.uint8, docs, at + 16 * docs)
    return decode_blocks(data, starts, count, size), lengths, [None if null else d for d, null in zip(doc_ids, nulls, strict=True)]


def write_id_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, ids_per_file: int = 4 << 20, block: int = 1024, share: float = 0.98) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order below ``out``; returns a row for each file.

    A file is written under a name of its own and then renamed, so a task that
    is run again, or twice at once, leaves the same files.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", tie)
    parts = shuffle_partitions(spark)
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, number = np.array([end_id], "<u4").tobytes(), 0
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            data = encode_file(np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held], doc_ids, block, share)
            name = f"ids-{part:06d}-{number:05d}.qpf"
            with store.open_output_stream(own := f"{folder}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            store.move(own, f"{folder}/{name}")
            row = {"file": [name], "part": [part], "number": [number], "documents": [len(doc_ids)], "ids": [size], "bytes": [len(data)]}
            held.clear()
            doc_ids.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(as_bytes(batch.column(1))), strict=True):
                held.append(ids + end)
                doc_ids.append(doc_id)
                size += len(ids) // 4 + 1
                if size >= ids_per_file:
                    yield flush()
        if held:
            yield flush()

    files = ordered.mapInArrow(write, "file string, part int, number int, documents long, ids long, bytes long")
    return saved(files, "id-files")


def read_id_files(spark: SparkSession, out: str, files: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start (ids of all documents before it), ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lengths, doc_ids = decode_file(data.as_py())
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                for at in range(0, len(ends), 512):
                    to = ends[at : at + 512]
                    begin = to - lengths[at : at + 512]
                    texts = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), to.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(to), pa.string()), pa.array(doc_ids[at : at + 512], pa.int64()), pa.array(begin, pa.int64()), pa.array(texts, pa.binary())], names=["file", "doc_id", "begin", "ids"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.qpf").load(out)
    found = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, "file string, doc_id long, begin long, ids binary")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "ids")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "ids")
    files = write_id_files(read_table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return digests(read_id_files(spark, out, files))
