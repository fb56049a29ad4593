"""Joins that keep one build row: last-wins lookup and as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_join(probe: DataFrame, build: DataFrame, key: str, payload: str, order: str, build_key: str | None = None, build_payload: str | None = None) -> DataFrame:
    """(key, payload) of each probe row that has a match: its payload XOR the build payload of its key.

    Of build rows with one key the last by ``order`` counts; ties there go to the
    larger payload. Probe rows that repeat each give a row, those without a match
    give none. Null keys match nothing. The build side is cut to a row for each
    key before the join, so a repeated key multiplies nothing.
    """
    b_key, b_payload = build_key or key, build_payload or payload
    last = F.max(F.struct(F.col(order).alias("at"), F.col(b_payload).alias("payload"))).getField("payload")
    one = build.where(F.col(b_key).isNotNull()).groupBy(F.col(b_key).alias("_key")).agg(last.alias("_found"))
    joined = probe.join(one, F.col(key) == F.col("_key"))
    return joined.select(F.col(key).alias("key"), F.col(payload).bitwiseXOR(F.col("_found")).alias("payload"))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, strict: bool = True, bucket: float | None = None) -> DataFrame:
    """The left rows with ``found``: of the right rows of the same ``by`` before ``at``, the latest ``value``.

    Both sides are merged and a window carries the last right row on, so a key's
    rows are sorted once and no pairs are made. With ``strict``, right rows at the
    very time don't count. ``found`` is null where nothing came before.

    With ``bucket`` (seconds, or units of a numeric ``at``) a key's rows are sorted
    bucket by bucket, so that a key with very many rows is spread over tasks; the
    last value of each bucket, a row for each, is carried on to the next ones.
    """
    columns = left.columns
    lefts = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(0 if strict else 1).alias("_side"))
    rights = right.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(1 if strict else 0).alias("_side"))
    merged = lefts.unionAll(rights)
    here = W.orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    last: Column = F.last("_value", ignorenulls=True)
    if bucket is None:
        return merged.withColumn("found", last.over(here.partitionBy("_by"))).where("_row is not null").select("_row.*", "found")
    kind = left.schema[at].dataType.typeName()
    number = F.col("_at").cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col("_at").cast("double")
    cut = merged.withColumn("_bucket", F.floor(number / bucket))
    ends = cut.groupBy("_by", "_bucket").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))).getField("_value").alias("_value"))
    before = W.partitionBy("_by").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("_by").alias("_c_by"), F.col("_bucket").alias("_c_bucket"), last.over(before).alias("_carried"))
    found = cut.withColumn("_found", last.over(here.partitionBy("_by", "_bucket"))).where("_row is not null")
    joined = found.join(carried, F.col("_by").eqNullSafe(F.col("_c_by")) & F.col("_bucket").eqNullSafe(F.col("_c_bucket")), "left")
    return joined.select("_row.*", F.coalesce("_found", "_carried").alias("found"))


def range_join(left: DataFrame, right: DataFrame, low: Column, high: Column, at: Column, width: float) -> DataFrame:
    """The pairs of rows with ``at`` of the right one between ``low`` and ``high`` of the left one.

    Both sides are cut into buckets of ``width``, and a left row is listed under
    each that its range touches; they meet by an equality join, which shuffles and
    can be split where a bucket is hot, instead of every row with every other. A
    width near the usual length of a range keeps the copies to two or so.
    """
    spread = left.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    buckets = F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))
    lefts, rights = spread.withColumn("_bucket", F.explode(buckets)), right.withColumn("_at", at).withColumn("_bucket", F.floor(at / width))
    return lefts.join(rights, "_bucket").where("_at between _low and _high").drop("_bucket", "_low", "_high", "_at")
