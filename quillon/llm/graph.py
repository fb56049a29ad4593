"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

ROUNDS = 40
#: Edge tables of up to this many bytes are joined up in one task.
ONE_TASK_BYTES = 8 << 20


def connected_components(edges: DataFrame, *like: Scratch, one_task: int = ONE_TASK_BYTES) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component's name is its smallest node.

    The distinct edges are written to the shared folder. While they are small by
    their measured size, one task joins them up. Beyond that, large-star and
    small-star rounds alternate, each of which hangs nodes on smaller neighbours,
    until nothing changes. A round's aggregates combine before their shuffle and
    are written down, so that the joins with them are broadcast while they are
    small, and else have two plain shuffled sides, which can be split where a
    node is hot; the round before is deleted.

    Loops and rows with a null end are dropped. ``like`` are tables that the
    edges are at most about as large as.
    """
    first = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"), F.col("u").alias("u0"), F.col("v").alias("v0"))
    table = Scratch(first.where("u0 is not null and v0 is not null and a <> b").select("a", "b").distinct(), "edges", *like)
    if table.bytes() <= one_task:
        return _in_one_task(table)
    mark = _mark(table.df)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        after = Scratch(_small_star(_large_star(table)).distinct(), "edges", table, table)
        table.drop()
        was, mark, table = mark, _mark(after.df), after
        if was == mark:
            break
    else:
        raise RuntimeError("components didn't settle")
    e = table.df
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _in_one_task(table: Scratch) -> DataFrame:
    kind = table.df.schema["a"].dataType.simpleString()
    arrow = table.df.limit(0).toArrow().schema.field("a").type

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):  # noqa: ANN001, ANN202
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, arrow), pa.array([top(x) for x in part], arrow)], names=["node", "component"])

    found = table.df.coalesce(1).mapInArrow(join_up, f"node {kind}, component {kind}")
    return Scratch(found, "components", table).df


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(table: Scratch) -> Scratch:
    """Every larger neighbour of a node becomes a neighbour of its smallest one, or of itself if it is smaller."""
    e = table.df
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = Scratch(both.groupBy("node").agg(F.min("other").alias("low")), "least", table, table)
    up = e.select(F.col("b").alias("node"), F.col("a").alias("other"))
    moved = up.join(sized(least), "node").select(F.col("other").alias("a"), F.least("node", "low").alias("b")).distinct()
    return Scratch(moved, "large-star", table)


def _small_star(table: Scratch) -> DataFrame:
    """Every smaller neighbour of a node, and the node, become neighbours of the smallest one."""
    least = Scratch(table.df.groupBy("a").agg(F.min("b").alias("low")), "least", table)
    moved = table.df.join(sized(least), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(least.df.select("a", F.col("low").alias("b")))
