"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct word shingles; its signature has one minimum
for each of ``coordinates`` hash functions. Two documents are candidates if at
least ``matches`` coordinates agree. Documents are posted under (coordinate,
value) pairs, and a pair of documents that agrees in ``matches`` of them must
meet under one of each one's ``coordinates - matches + 1`` rarest, so only those
are posted (prefix). Values that one document alone has cannot be met and are
skipped, and so is every document that shares fewer than ``matches`` values with
anyone. Candidates are confirmed on full sets.

At the default setting, a pair just at the threshold of 0.85 has fewer than 28
of 48 coordinates in common with a probability of about 3 in a million, and
closer pairs far less.

Defined results: a text without words, or null, has an empty set (n_shingles 0)
and is linked with nothing; fewer words than a shingle make one shingle of all;
documents of equal sets form a class and are expanded from its smallest doc_id;
rows that share a doc_id are one document and linked; rows with a null doc_id
are returned with a null component and kept = false; an empty table gives an
empty one; other columns pass by. A text of any length is shingled whole, with
about 50 bytes for each word; a run holds 16 MB of sets or two documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, as_bytes, read_table, saved, sized, slices, window_hashes
from .graph import connected_components
from .linkage import linked


def shingle_set(text: bytes | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, ASCII letters lower-cased."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words.of(parts), min(width, len(parts))))


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the signature's hash functions."""
    rng = np.random.default_rng(20_240_501)
    draw = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draw[0] << np.uint64(1) | np.uint64(1), draw[1]


def signature(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, as 32-bit integers."""
    low = np.full(len(multipliers), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, (part[None, :] * multipliers[:, None] + offsets[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def link_share(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both, len(a) + len(b) - both


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_md5 and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        functions = hash_functions(coordinates)
        for batch in slices(batches):
            counts, names, signs = [], [], []
            for text in as_bytes(batch.column(1)):
                found = shingle_set(text, width, words)
                counts.append(len(found))
                names.append(hashlib.md5(found.tobytes(), usedforsecurity=False).digest() if len(found) else None)
                signs.append(signature(found, *functions) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_md5", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_md5 binary, signature array<int>")


def _candidate_edges(table: Scratch, coordinates: int, matches: int, percent: int) -> DataFrame:
    """A forest (u, v) with the components of all pairs that agree in enough coordinates and could be near enough in size."""
    reps = table.df
    element = (F.col("at").cast("long") * F.lit(1 << 32) + F.col("value").cast("long")).alias("element")
    posted = reps.select("doc_id", F.posexplode("signature").alias("at", "value")).select("doc_id", element)
    # written down, so that the join's sides are plain and a value that very many documents share can be split
    common = saved(posted.groupBy("element").agg(F.count("*").alias("df")).where("df > 1"), "common-values", table)
    # each list has at most one entry for each coordinate
    lists = posted.join(common, "element").groupBy("doc_id").agg(F.collect_list(F.struct("df", "element")).alias("met")).where(F.size("met") >= matches)
    prefix = F.slice(F.array_sort("met"), F.lit(1), F.size("met") - F.lit(matches - 1))
    survivors = saved(reps.join(lists.select("doc_id", prefix.alias("prefix")), "doc_id"), "survivors", table)
    postings = survivors.select("doc_id", "n_shingles", "signature", F.explode("prefix.element").alias("element"))

    def matcher(rows: pa.RecordBatch) -> tuple:
        nodes = rows.column(0)
        sizes = rows.column(1).to_numpy()
        signs = rows.column(2).values.to_numpy()[rows.column(2).offsets.to_numpy()[0] :][: len(nodes) * coordinates].reshape(-1, coordinates)

        def match(k: int, others: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])
            near[near] = (signs[others[near]] == signs[k]).sum(axis=1) >= matches
            return near

        return np.arange(len(nodes)), match

    return linked(postings, "element", "doc_id", ["doc_id", "n_shingles", "signature"], matcher, table)


def _confirmed_edges(docs: DataFrame, groups: Scratch, width: int, coordinates: int, matches: int, percent: int) -> DataFrame:
    """A forest with the components of the pairs that hold on full sets, inside each candidate component."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        functions = hash_functions(coordinates)
        for batch in slices(batches):
            found = [shingle_set(text, width, words) for text in as_bytes(batch.column(2))]
            md5 = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in found]
            mine = [k for k, (a, b) in enumerate(zip(md5, batch.column(3).to_pylist(), strict=True)) if a == b]
            own = batch.take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array([signature(found[k], *functions).tobytes() for k in mine], pa.binary()), pa.array([found[k].tobytes() for k in mine], pa.binary())], names=["doc_id", "component", "set_md5", "signature", "shingles"])

    def matcher(rows: pa.RecordBatch) -> tuple:
        signs = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int32).reshape(-1, coordinates)
        found = [np.frombuffer(x, np.uint64) for x in rows.column(2).to_pylist()]
        sizes = np.array([len(x) for x in found])
        # the member nearest to what most agree on comes first: copies of one text are near to it
        votes = np.zeros(len(found), np.int64)
        for k in range(coordinates):
            _, inverse, count = np.unique(signs[:, k], return_inverse=True, return_counts=True)
            votes += count[inverse]

        def match(k: int, others: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])
            near[near] = (signs[others[near]] == signs[k]).sum(axis=1) >= matches
            for x in np.flatnonzero(near):
                both, either = link_share(found[k], found[others[x]])
                near[x] = 100 * both >= percent * either
            return near

        return np.argsort(-votes, kind="stable"), match

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(sized(groups).drop("n_shingles"), "doc_id").select("doc_id", "component", "text", "set_md5")
    members = wanted.mapInArrow(sets, "doc_id long, component long, set_md5 binary, signature binary, shingles binary").dropDuplicates(["doc_id", "set_md5"])
    return linked(members, "component", "doc_id", ["doc_id", "signature", "shingles"], matcher, groups, sizes=groups.df, weight=8 * F.col("n_shingles") + 8 * coordinates)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; linked are sets with 100 * intersection >= percent * union."""
    table = Scratch(signatures(docs, width, coordinates), "signatures")
    rows = table.df
    # the members of a class: rows of one set, named after its smallest doc_id
    classes = saved(rows.where("set_md5 is not null and doc_id is not null").groupBy("set_md5").agg(F.min("doc_id").alias("class")), "sets", table)
    named = saved(rows.drop("signature").join(classes, "set_md5", "left"), "classes", table)
    reps = Scratch(classes.withColumnRenamed("class", "doc_id").join(rows, ["doc_id", "set_md5"]).dropDuplicates(["doc_id", "set_md5"]).select("doc_id", "set_md5", "n_shingles", "signature"), "representatives", table)
    candidates = connected_components(_candidate_edges(reps, coordinates, matches, percent), reps)
    groups = Scratch(candidates.select(F.col("node").alias("doc_id"), "component").join(reps.df.select("doc_id", "set_md5", "n_shingles"), "doc_id"), "candidates", reps)
    links = _confirmed_edges(docs, groups, width, coordinates, matches, percent)
    # a doc_id with several sets joins their classes
    spread = named.where("class is not null and class <> doc_id").select(F.col("class").alias("u"), F.col("doc_id").alias("v"))
    twice = named.where("class is not null").groupBy("doc_id").agg(F.countDistinct("class").alias("n")).where("n > 1").select("doc_id")
    joined = spread.join(twice, F.col("v") == F.col("doc_id"), "left_semi")
    components = Scratch(connected_components(links.unionAll(joined), reps), "components", reps)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
    final = named.join(sized(components).withColumnRenamed("node", "class"), "class", "left")
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


#: Exact pairs of sets that meet in a shingle, and their components, for small tables.
ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
shingles as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) s
  from words),
one as (select doc_id, len(s) n, unnest(s) x from shingles),
pairs as (
  select a.doc_id u, b.doc_id v, count(*) c, any_value(a.n) n, any_value(b.n) m
  from one a join one b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
links as (select u, v from pairs where 100 * c >= 85 * (n + m - c)),
ways as (select u, v from links union all select v, u from links),
reach as (select doc_id node, doc_id root from documents union select w.v, r.root from reach r join ways w on w.u = r.node),
roots as (select node, min(root) root from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, r.root component_id, s.doc_id = r.root kept
from shingles s join roots r on r.node = s.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85, coordinates=48, matches=28)
