"""Exact top-k by inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it. Rows are dealt
in ranges of (length class, pivot, distance, vec_id), so a part of the index holds
sorted rings around pivots, and equal vectors, however many, spread over parts by
vec_id. A part cuts its rows into annuli. For a query q and an annulus around
pivot p whose vectors have distances r1..r2 and norms up to m, the triangle
inequality bounds every score there:

    |q - x| >= d, the distance of |q - p| to [r1, r2], so q.x <= (|q|^2 + m^2 - d^2) / 2
    q.x = q.p + q.(x - p) <= q.p + |q| r2

Annuli are visited from the largest bound down, and a query stops when the bound
of all that is left is below its k-th score. The first pass asks only the part
that holds the query itself; its k-th score is the floor for the others. A table
of rings (one row for each part and pivot) then says which parts have a bound that
reaches the floor, and a query goes to those alone. In a task, a part's rows are
held once and the queries stream past, so its memory doesn't grow with either.

Components are doubles with whole values; scores are exact whatever their size.
What doesn't fit 64 bits is ranked exactly, and its score is the largest or
smallest long.

Defined results: vectors that are null or hold a component that is null or not
finite, before or after it is multiplied, take no part, nor do rows with a null
vec_id; of two vectors of different lengths the components that both have count,
so an empty one scores 0; rows that share a vec_id are one candidate each, and a
query never finds its own vec_id; a query id that repeats is asked once, with one
of its vectors; fewer candidates than k give all; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, read_table, saved, shuffle_partitions

SCALE = 1024
ANNULUS = 512
QUERY_BLOCK = 64
#: Rows and bytes in a part of the index, at most, so that a task can hold one.
PART_ROWS, PART_BYTES = 50_000, 32 << 20
SAMPLE_ROWS, PIVOTS = 2048, 48
LONGEST, LOWEST = (1 << 63) - 1, -(1 << 63)
#: Length classes of vectors, at most.
CLASSES = 64
SCORES = "query_id long, vec_id long, score long, exact string"


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and floor(1024 * x) of every component, as doubles, for the rows that take part."""
    # beyond 2^53 every double is whole
    whole = F.transform(F.col(vector).cast("array<double>"), lambda c: F.when(F.abs(c * SCALE) < 2.0**53, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    rows = table.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    return rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    picks = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(picks) < count and near.max() > 0:
        picks.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[picks[-1]], axis=1))
    return sample[picks]


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """The rows cut or filled with zeros to a width."""
    if rows.shape[1] >= width:
        return rows[:, :width]
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def inner(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products of a vector with rows of whole numbers: 64-bit integers, or Python's if one needs more."""
    most = np.abs(rows).max(axis=1, initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if most.max(initial=0.0) < 2.0**53:
        return (rows @ query).astype(np.int64)
    wide = most >= 2.0**62
    out = np.empty(len(rows), object if wide.any() else np.int64)
    small = ~wide & (np.abs(query).max(initial=0.0) < 2.0**62)
    out[small] = rows[small].astype(np.int64) @ np.where(np.abs(query) < 2.0**62, query, 0.0).astype(np.int64)
    if not small.all():
        whole = [int(x) for x in query.tolist()]
        for k in np.flatnonzero(~small).tolist():
            out[k] = sum(a * int(b) for a, b in zip(whole, rows[k].tolist(), strict=True))
    return out


def exact_key(score: int) -> str:
    """A text that sorts as whole numbers do."""
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return "p" + text if score >= 0 else "n" + text.translate(str.maketrans("0123456789", "9876543210"))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda n: (-scores[n], ids[n]))[:k], np.int64)
    if len(scores) > 4 * k:
        low = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= low)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def bounds(queries: np.ndarray, pivots: np.ndarray, ring_pivot: np.ndarray, inside: np.ndarray, outside: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """What no score of a query (row) with a vector of a ring (column) exceeds; infinite where numbers are too large to tell."""
    with np.errstate(all="ignore"):
        square = (queries**2).sum(axis=1)
        width = min(queries.shape[1], pivots.shape[1])
        product = queries[:, :width] @ pivots[:, :width].T
        own = (pivots**2).sum(axis=1)
        to_pivot = np.sqrt(np.maximum(square[:, None] + own[None] - 2 * product, 0))[:, ring_pivot]
        gap = np.maximum(0, np.maximum(inside[None] - to_pivot, to_pivot - outside[None]))
        found = np.minimum((square[:, None] + longest[None] ** 2 - gap**2) / 2, product[:, ring_pivot] + np.sqrt(square)[:, None] * outside[None])
        # rounding never hides a candidate
        found += 1 + 1e-7 * (square[:, None] + own[ring_pivot][None] + longest[None] ** 2 + outside[None] ** 2)
        found[~np.isfinite(found)] = np.inf
    return found


class Part:
    """The rows of one part, sorted by pivot and distance, in annuli."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivot_of: np.ndarray, distance: np.ndarray, pivots: np.ndarray):
        self.ids, self.rows, self.pivots = ids, rows, pivots
        edges = np.flatnonzero(np.diff(pivot_of)) + 1
        self.starts = [s for a, b in zip([0, *edges], [*edges, len(ids)], strict=True) for s in range(int(a), int(b), ANNULUS)]
        self.ends = [*self.starts[1:], len(ids)]
        with np.errstate(all="ignore"):
            norms = np.linalg.norm(rows, axis=1)
        self.rings = pivot_of[self.starts], distance[self.starts], distance[[e - 1 for e in self.ends]], np.array([norms[a:b].max() for a, b in zip(self.starts, self.ends, strict=True)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, its best candidates of this part: none that falls below its floor, at most k."""
        bound = bounds(queries, self.pivots, *self.rings)
        short = fitted(queries, self.rows.shape[1])
        for n in range(len(query_ids)):
            # the smallest long stands for no floor: scores may lie below it
            floor = int(floors[n]) if floors[n] > LOWEST else -np.inf
            held_ids, held = np.empty(0, np.int64), np.empty(0, np.int64)
            for ring in np.argsort(-bound[n], kind="stable"):
                if bound[n, ring] < floor:
                    break
                part = slice(self.starts[ring], self.ends[ring])
                # a query's own row is no candidate, so it isn't multiplied
                others = self.ids[part] != query_ids[n]
                ids, scores = self.ids[part][others], inner(short[n], self.rows[part][others])
                fine = np.flatnonzero(scores >= floor)
                held_ids, held = np.concatenate([held_ids, ids[fine]]), np.concatenate([held, scores[fine]])
                if len(held) > k:
                    top = best(held_ids, held, k)
                    held_ids, held = held_ids[top], held[top]
                if len(held) == k:
                    floor = max(floor, min(int(min(held)), LONGEST))
            yield int(query_ids[n]), held_ids, held


def _vectors(column: pa.Array) -> np.ndarray:
    """Packed doubles of any lengths as rows, filled with zeros."""
    packed = column.to_pylist()
    sizes = {len(x) for x in packed}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    out = np.zeros((len(packed), max(sizes, default=0) // 8))
    for row, x in zip(out, packed, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def build_index(vectors: DataFrame, pivots: np.ndarray) -> Scratch:
    """Rows with pivot, distance, norm and part; written to the shared folder, so parts stay as they are."""
    spark = vectors.sparkSession

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                x = values[first[mine][:, None] + np.arange(length)[None]].astype(np.float64)
                width = max(length, pivots.shape[1])
                wide, p = fitted(x, width), fitted(pivots, width)
                with np.errstate(all="ignore"):
                    square = (p**2).sum(axis=1)[None] - 2 * wide @ p.T
                    near = np.where(np.isfinite(square), square, np.inf).argmin(axis=1)
                    distance, norm = np.linalg.norm(wide - p[near], axis=1), np.linalg.norm(x, axis=1)
                kind = np.full(len(mine), length.bit_length())
                columns = [batch.column(0).take(pa.array(mine)), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(near, pa.int32()), pa.array(distance), pa.array(norm), pa.array(kind, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "pivot", "distance", "norm", "kind"])

    keyed = saved(vectors.mapInArrow(key, "vec_id long, v binary, pivot int, distance double, norm double, kind int"), "keyed-vectors")
    total = keyed.agg(F.count("*"), F.sum(F.length("v") + 64)).first()
    parts = max(shuffle_partitions(spark), -(-total[0] // PART_ROWS), -(-(total[1] or 0) // PART_BYTES))
    dealt = keyed.repartitionByRange(parts, "kind", "pivot", "distance", "vec_id")
    part = F.spark_partition_id().cast("long") * CLASSES + F.col("kind")
    return Scratch(dealt.withColumn("part", part), "vector-index")


def _probe(index: DataFrame, asked: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Best candidates of each part for the queries sent to it (part, vec_id, v, floor)."""
    none = F.lit(None)
    rows = index.select("part", F.lit(0).alias("asks"), "pivot", "distance", "vec_id", "v", none.cast("long").alias("floor"))
    queries = asked.select("part", F.lit(1).alias("asks"), none.cast("int").alias("pivot"), none.cast("double").alias("distance"), "vec_id", "v", "floor")
    dealt = rows.unionAll(queries).repartition("part").sortWithinPartitions("part", "asks", "pivot", "distance", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(c)) for c in (0, 1)]
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                some = batch.slice(a, b - a)
                if keys[0][a] != name:
                    name, held, part = keys[0][a], [], None
                if keys[1][a] == 0:
                    held.append(some)
                    continue
                if part is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                    part = Part(whole.column(4).to_numpy(), _vectors(whole.column(5)), whole.column(2).to_numpy(), whole.column(3).to_numpy(), pivots)
                if part is not None:
                    for at in range(0, some.num_rows, QUERY_BLOCK):
                        block = some.slice(at, QUERY_BLOCK)
                        yield _hits(part.search(block.column(4).to_numpy(), _vectors(block.column(5)), block.column(6).to_numpy(), k))

    return dealt.mapInArrow(run, SCORES)


def _hits(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    out: list[tuple] = []
    for query, ids, scores in found:
        for vec_id, score in zip(ids.tolist(), scores.tolist(), strict=True):
            clamped = max(LOWEST, min(LONGEST, score))
            out.append((query, vec_id, clamped, exact_key(score) if clamped in (LOWEST, LONGEST) else None))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "vec_id", "score", "exact"])


def _routed(queries: DataFrame, rings: Scratch, pivots: np.ndarray) -> DataFrame:
    """part, vec_id, v and floor: each query for each part, but its own, whose bound reaches its floor.

    The rings are one row for each part and pivot in it, so one for tens of
    thousands of vectors. Beyond the size of a broadcast nothing is left out.
    """
    if rings.bytes() * 4 > BROADCAST_BYTES:
        parts = rings.df.groupBy().agg(F.collect_set("part").alias("parts"))
        return queries.join(F.broadcast(parts)).withColumn("part", F.explode("parts")).where("part <> home").select("part", "vec_id", "v", "floor")
    table = rings.df.select("part", "pivot", "inside", "outside", "longest").toArrow()
    part, pivot, *measures = (np.asarray(table.column(c)) for c in range(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                block = batch.slice(at, QUERY_BLOCK)
                if not block.num_rows:
                    continue
                floors = block.column(3).to_numpy()[:, None]
                reach = (bounds(_vectors(block.column(1)), pivots, pivot, *measures) >= floors) | (floors == LOWEST)
                reach &= part[None] != block.column(2).to_numpy()[:, None]
                pairs = np.unique(np.stack([np.nonzero(reach)[0], part[np.nonzero(reach)[1]]], axis=1), axis=0)
                # a few copies of a vector at a time
                for first in range(0, len(pairs), 4096):
                    which = pairs[first : first + 4096]
                    own = block.take(pa.array(which[:, 0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(which[:, 1], pa.int64()), own.column(0), own.column(1), own.column(3)], names=["part", "vec_id", "v", "floor"])

    return queries.select("vec_id", "v", "home", "floor").mapInArrow(run, "part long, vec_id long, v binary, floor long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best; lists are cut before and after they meet."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row that ``asked`` holds for; vectors is (vec_id, v array<double>)."""
    spark = vectors.sparkSession
    # about SAMPLE_ROWS rows, by a hash; a vector that repeats counts as one
    share = min(1.0, SAMPLE_ROWS / max(1, vectors.count()))
    chosen = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").distinct()
    sample = [r["v"] for r in chosen.limit(2 * SAMPLE_ROWS).collect() or vectors.select("v").limit(1).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = [len(v) for v in sample]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    calm = [v for v in sample if len(v) == usual and max(map(abs, v), default=0.0) < 1e100]
    pivots = choose_pivots(np.array(calm or [[0.0] * usual], np.float64))
    table = build_index(vectors, pivots)
    index = table.df
    rings = Scratch(index.groupBy("part", "pivot").agg(F.min("distance").alias("inside"), F.max("distance").alias("outside"), F.max("norm").alias("longest")), "rings")
    own = index.where(asked).groupBy("vec_id").agg(F.min(F.struct("v", "part")).alias("x"))
    queries = saved(own.select("vec_id", "x.v", F.col("x.part").alias("home")), "queries", table)
    # first pass: the part that holds the query itself
    first = saved(_probe(index, queries.select(F.col("home").alias("part"), "vec_id", "v", F.lit(LOWEST).alias("floor")), pivots, k), "first-pass")
    floors = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    ready = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "home", F.coalesce("least", F.lit(LOWEST)).alias("floor"))
    second = _probe(index, _routed(ready, rings, pivots), pivots, k)
    return _merged(first.unionAll(second), k)


#: Exact for tables whose queries are few enough for SQL.
ORACLE_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) score
  from whole q join whole c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)
