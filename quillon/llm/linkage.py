"""Links inside groups, found task by task without writing out the groups' pairs.

Rows are shuffled by a group's name and sorted, so a task meets each group as
one run of rows. Inside a run a search starts at one row, compares it with all
rows not yet reached at once, and goes on from those that match. What it writes
is a forest: fewer links than rows, with the same connected components as all
matching pairs.

A group of more than ``BLOCK`` rows, or of more than ``BLOCK_BYTES``, is cut into
chunks by a hash of its rows' nodes, and a few of its rows (``ENVOYS``) go to all
chunks. So a chunk is one run of bounded size, and rows that match an envoy,
directly or over others of their chunk, are connected with those of all chunks.
Only rows that aren't yet in the component that most of their group's rows are in
can still have links to find; each of them is then compared with all rows of its
group that it isn't connected with, chunk by chunk. A group of copies is thus
searched in time proportional to its size, and no pair is left out anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, sized
from .graph import connected_components

BLOCK = 256
#: Bytes of a chunk, by what the caller says its rows weigh; a row is never cut.
BLOCK_BYTES = 16 << 20
#: Rows of a large group that go to all of its chunks.
ENVOYS = 4
#: Buckets that groups are counted in before they are counted one by one.
COARSE = 1 << 16

#: The rows of a run: the order in which searches start, and which of ``others`` match row k.
Matcher = Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray]]]


def large_groups(rows: DataFrame, group: str, node: str, weight: Column, block: int, block_bytes: int, *like: Scratch) -> Scratch | None:
    """(_group, _chunks, _envoys) of the groups of more than one chunk; None if there are none.

    Counts go to ``COARSE`` buckets first, where each task sends a row for each
    bucket at most. Only the groups of buckets with enough rows are counted one
    by one.
    """
    bucket = F.pmod(F.xxhash64(group), F.lit(COARSE)).alias("_bucket")
    heavy = (F.col("_n") > block) | (F.col("_bytes") > block_bytes)
    counts = (F.count("*").alias("_n"), F.sum(weight).alias("_bytes"))
    full = Scratch(rows.groupBy(bucket).agg(*counts).where(heavy).select("_bucket"), "full-buckets", *like)
    if full.df.isEmpty():
        return None
    some = rows.withColumn("_bucket", bucket).join(F.broadcast(full.df), "_bucket", "left_semi")
    mix = F.xxhash64(F.lit("envoy"), node)
    envoys = [F.min(F.when(F.pmod(mix, F.lit(ENVOYS)) == k, F.struct(mix.alias("m"), F.col(node).alias("n")))).getField("n").alias(f"_e{k}") for k in range(ENVOYS)]
    counted = some.groupBy(F.col(group).alias("_group")).agg(*counts, *envoys).where(heavy)
    chunks = F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_bytes") / block_bytes))
    found = Scratch(counted.select("_group", F.least(chunks, F.col("_n")).cast("int").alias("_chunks"), F.array_compact(F.array(*[f"_e{k}" for k in range(ENVOYS)])).alias("_envoys")), "large-groups", *like)
    return None if found.df.isEmpty() else found


def linked(rows: DataFrame, group: str, node: str, columns: list[str], matcher: Matcher, *like: Scratch, sizes: DataFrame | None = None, weight: Column | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A forest (u, v) of nodes, with the components of all matching pairs inside groups.

    ``columns`` are what the matcher reads, the node first. ``sizes`` are rows with
    the same groups and nodes that are cheaper to count, and ``weight`` what one of
    them stands for in bytes. ``like`` are tables as large as what is counted.
    """
    counted = rows if sizes is None else sizes
    large = large_groups(counted, group, node, F.lit(0) if weight is None else weight, block, block_bytes, *like)
    named = rows.select(F.col(group).alias("_group"), *columns)
    if large is None:
        return _runs(named.withColumn("_run", F.lit(0).cast("long")), columns, lambda run: _forest(run, matcher))
    # read twice, if some rows stay open
    kept = Scratch(named, "rows-to-link")
    own = F.pmod(F.xxhash64(node), F.col("_chunks")).cast("long")
    spread = kept.df.join(sized(large), "_group", "left").withColumn("_own", F.coalesce(own, F.lit(0).cast("long")))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda k: k.cast("long"))
    runs = spread.withColumn("_run", F.explode(F.when(F.array_contains("_envoys", F.col(node)), everywhere).otherwise(F.array("_own"))))
    first = Scratch(_runs(runs, columns, lambda run: _forest(run, matcher)), "links")

    # the rows of large groups whose component isn't their group's largest
    hot = counted.select(F.col(group).alias("_group"), F.col(node).alias("_node")).join(sized(large), "_group")
    found = Scratch(connected_components(first.df, *like).select(F.col("node").alias("_node"), F.col("component").alias("_label")), "labels", *like)
    labelled = Scratch(hot.join(sized(found), "_node", "left").select("_group", "_node", "_chunks", F.coalesce("_label", "_node").alias("_label")), "labelled", *like)
    each = labelled.df.groupBy("_group", "_label").agg(F.count("*").alias("_n"))
    mains = Scratch(each.groupBy("_group").agg(F.max(F.struct("_n", "_label")).getField("_label").alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).where("_most < _all"), "main-components", large)
    if mains.df.isEmpty():
        return first.df
    open_chunks = mains.df.select("_group", "_main", F.ceil((F.col("_all") - F.col("_most")) / block).cast("int").alias("_open_chunks"))
    state = labelled.df.join(open_chunks, "_group").select("_group", F.col("_node").alias(node), "_label", "_chunks", "_open_chunks", (F.col("_label") != F.col("_main")).alias("_open")).distinct()
    at = F.xxhash64(node)
    # most rows are in groups that aren't large, and go before the join
    both = kept.df.join(sized(mains).select("_group"), "_group", "left_semi").join(state, ["_group", node]).withColumn("_chunk", F.pmod(at, F.col("_chunks")).cast("long"))
    lefts = both.where("_open").withColumn("_left", F.lit(True)).withColumn("_i", F.pmod(at, F.col("_open_chunks")).cast("long")).withColumn("_j", F.explode(everywhere))
    rights = both.withColumn("_left", F.lit(False)).withColumn("_i", F.explode(F.transform(F.sequence(F.lit(0), F.col("_open_chunks") - 1), lambda k: k.cast("long")))).withColumn("_j", F.col("_chunk"))
    second = lefts.unionByName(rights).withColumn("_run", F.col("_i") * F.lit(1 << 32) + F.col("_j"))
    more = _runs(second, [*columns, "_label", "_chunk", "_open", "_left"], lambda run: _joined(run, matcher))
    return first.df.unionAll(more)


def _runs(rows: DataFrame, columns: list[str], process: Callable[[pa.RecordBatch], list[tuple]]) -> DataFrame:
    """Applies ``process`` to the rows of each run of two or more (columns as named) and returns the (u, v) it gives."""
    # a number of parts that is given stays: a few bytes of rows may be much to compare
    dealt = rows.select("_group", "_run", *columns).repartition(shuffle_partitions(rows.sparkSession), "_group", "_run").sortWithinPartitions("_group", "_run")

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        out: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(k)) for k in range(2)]
            edges = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [batch.num_rows]])
            if (keys[0][0], keys[1][0]) == name:
                held.append(batch.slice(0, int(ends[0])))
            else:
                out += _whole(held, process)
                held = [batch.slice(0, int(ends[0]))]
            if len(starts) > 1:
                out += _whole(held, process)
                inner = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                for k in inner.tolist():
                    out += _whole([batch.slice(int(starts[k]), int(ends[k] - starts[k]))], process)
                    if len(out) >= 10_000:
                        yield _links(out, types)
                        out = []
                held = [batch.slice(int(starts[-1]))]
            name = (keys[0][-1], keys[1][-1])
        out += _whole(held, process)
        yield _links(out, types)

    types = rows.select(columns[0]).schema[0].dataType.simpleString()
    return dealt.mapInArrow(search_all, f"u {types}, v {types}")


def _whole(held: list[pa.RecordBatch], process: Callable[[pa.RecordBatch], list[tuple]]) -> list[tuple]:
    if sum(b.num_rows for b in held) < 2:
        return []
    whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return process(whole.select(whole.schema.names[2:]))


def _links(out: list[tuple], kind: str) -> pa.RecordBatch:
    t = pa.int64() if kind == "bigint" else pa.string()
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], t), pa.array([v for _, v in out], t)], names=["u", "v"])


def _forest(run: pa.RecordBatch, matcher: Matcher) -> list[tuple]:
    order, matches = matcher(run)
    nodes = run.column(0).to_pylist()
    return [(nodes[a], nodes[b]) for a, b in search(len(nodes), order, matches)]


def _joined(run: pa.RecordBatch, matcher: Matcher) -> list[tuple]:
    """Links of the open rows with the others that they aren't connected with: one for each component that they meet.

    Rows of one chunk that aren't connected were compared in the first search, all with
    all, and two open rows meet twice, each as the other's left one; the smaller node counts.
    """
    label, chunk, is_open, left = (run.column(k) for k in range(run.num_columns - 4, run.num_columns))
    nodes = run.column(0).to_pylist()
    left, is_open, chunk = np.asarray(left.to_pylist(), bool), np.asarray(is_open.to_pylist(), bool), np.asarray(chunk)
    _, part = np.unique(np.array(label.to_pylist(), object).astype(str), return_inverse=True)
    _, rank = np.unique(np.array(nodes, object), return_inverse=True)
    rest = np.flatnonzero(~left)
    _, matches = matcher(run.select(run.schema.names[:-4]))
    links = []
    for k in np.flatnonzero(left).tolist():
        others = rest[(part[rest] != part[k]) & (chunk[rest] != chunk[k]) & (~is_open[rest] | (rank[rest] > rank[k]))]
        if len(others):
            hits = others[matches(k, others)]
            met, at = np.unique(part[hits], return_index=True)
            for x in hits[at].tolist():
                links.append((nodes[k], nodes[x]))
            part[np.isin(part, met)] = part[k]
    return links


def search(count: int, order: np.ndarray, matches: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph that ``matches(k, others)`` describes: those of ``others`` that match k.

    ``order`` says where searches start, and which of the rows reached goes on first.
    """
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    left = order.copy()
    links: list[tuple[int, int]] = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            k = front.pop(0)
            hit = matches(k, left)
            if hit.any():
                reached = left[hit]
                links += [(k, int(x)) for x in reached]
                left = left[~hit]
                front = sorted([*front, *reached.tolist()], key=rank.__getitem__)
    return links
