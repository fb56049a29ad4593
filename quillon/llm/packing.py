"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two (whole
sequences of the longest length first, then the binary digits of the rest).
Every piece is a sequence of its own, so no sequence crosses documents and none
needs padding; sequences of equal length form a bucket and get consecutive
numbers, so a loader draws batches of one length.

Defined results: a null text is an empty document (its end id alone); a null
doc_id is carried; repeated rows are packed each for itself; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, read_table, saved, sized, slices
from .token_ids import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, rank long"


def piece_lengths(n: int, longest: int = 2048) -> list[int]:
    """Powers of two, the largest first, that add up to n; none is over ``longest``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian u32), sequence_id, offset.

    Texts are tokenized once, where they are read, and written to the shared
    folder; nothing but one small row for each task and length is shuffled.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ranks: dict[int, int] = {}
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(as_bytes(batch.column(1))), strict=True):
                ids += end
                start, total = 0, len(ids) // 4
                for length in piece_lengths(total, longest):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    out.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)], part, rank))
                    start += length
            columns = zip(*out, strict=True)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            names = ("doc_id", "start", "length", "doc_tokens", "ids", "part", "rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    pieces = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.orderBy(F.desc("length"), "part").rowsBetween(W.unboundedPreceding, -1)
    bases = Scratch(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return pieces.join(sized(bases), ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
