"""Scratch tables, size-checked joins and bounded caches."""

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import common


def test_scratch_is_written_below_the_checkpoint_folder(spark):
    table = common.Scratch(spark.range(100).repartition(7), "t")
    assert table.path.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/quillon-")
    assert table.bytes() > 0 and table.df.count() == 100 and table.df.dtypes == [("id", "bigint")]
    few = common.Scratch(spark.range(100).repartition(7), "t", table)
    assert few.df.rdd.getNumPartitions() == 1
    table.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|No such file"):
        spark.read.parquet(table.path).count()


def test_broadcast_only_within_the_bound(spark, monkeypatch):
    table = common.Scratch(spark.range(1000), "t")
    big = spark.range(5000)
    plan = lambda: big.join(common.sized(table), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    assert "broadcast" not in plan() and big.join(common.sized(table), "id").count() == 1000


def test_word_hashes_are_bounded_and_stable(monkeypatch):
    monkeypatch.setattr(common.WordHashes, "LIMIT", 3)
    h = common.WordHashes()
    words = [b"a", b"b", b"c", b"d", b"a", b"x" * 100]
    first = h.of(words)
    assert len(h) <= 3 and (first == common.WordHashes().of(words)).all() and first[0] == first[4]


def test_window_hashes_tell_order_apart():
    x = np.array([1, 2, 3, 2, 1, 1, 2, 3], np.uint64)
    found = common.window_hashes(x, 3)
    assert len(found) == 6 and found[0] == found[5] and len(set(found.tolist())) == 5
    assert len(common.window_hashes(x[:2], 3)) == 0


def test_slices_and_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["é", None, "x"]})
    parts = list(common.slices([batch], 2))
    assert [common.as_bytes(p.column(0)) for p in parts] == [["é".encode(), None], [b"x"]]
