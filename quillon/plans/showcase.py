"""Queries that apply the library's own operators to the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ir
from ..functions.binary import unsigned
from ..functions.checksum import crc32c
from ..functions.checksum import table as checksum_table
from ..operators.aggregate import aggregate_f64, total_f64
from ..operators.lookup_join import asof_join, lookup_join, range_join
from ..operators.radix import radix_counts, radix_partition, wrapping
from ..operators.radix import mix as hash_mix
from ..operators.star import average_score
from ..sources import innodb
from ..streaming.windows import sessions, tumbling
from .frontend import PlanService, summarize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sum_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate_f64(_table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return found.select("l_returnflag", "sum", "min", "max")


def sum_min_max_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _table(spark, sf_dir, "lineitem").where("l_quantity < 0")
    return aggregate_f64(none, "l_quantity").select("sum", F.col("min").cast("string").alias("min"), F.col("max").cast("string").alias("max"))


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(total_f64("l_quantity").alias("total"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe, build = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return lookup_join(probe, build, "c_custkey", "c_nationkey", "o_orderkey", "o_custkey", "o_orderkey").withColumnRenamed("payload", "x").withColumnRenamed("key", "k")


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = asof_join(events, events.withColumn("t", F.col("ts")), "user_id", "ts", "t", bucket=86_400.0)
    return found.select("event_id", F.col("found").alias("t"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = _table(spark, sf_dir, "part").select("p_retailprice"), _table(spark, sf_dir, "supplier").select("s_acctbal")
    met = range_join(parts, suppliers, F.col("p_retailprice"), F.col("p_retailprice") + 100, F.col("s_acctbal"), 100.0)
    return met.agg(F.count("*").alias("n"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "part")
    return wrapping(spark, lambda: keys.select("p_partkey", hash_mix(F.col("p_partkey")).alias("h")))


#: A checksum's register over the bytes of an ASCII text, in DuckDB.
_CRC_SQL = f"""with r as (select p_partkey, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::bigint)),
    lambda c, b: xor(c >> 8, ({list(checksum_table())}::bigint[])[(xor(c, b) & 255) + 1])) register from part)
    select p_partkey, xor(register, 4294967295) crc, register from r"""
#: A 64-bit integer read without its sign, in DuckDB.
_U = "(case when {0} < 0 then {0}::hugeint + 18446744073709551616 else {0}::hugeint end)"
_MULTIPLY = "((({0}) & 4294967295)::hugeint * {1}::hugeint + (((({0}) >> 32)::hugeint * {1}::hugeint) % 4294967296) * 4294967296) % 18446744073709551616"


def _mix_sql(key: str, table: str) -> str:
    """The finalizer in 128-bit integers, a step at a time."""
    xor = "xor({0}, ({0}::ubigint >> 33)::ubigint)"
    return f"""
select *, (xor(k4, (k4 >> 32)) & 4294967295)::bigint h from (
select *, {xor.format("k3")} k4 from (
select *, ({_MULTIPLY.format("k2", "14181476777654086739")})::ubigint k3 from (
select *, {xor.format("k1")} k2 from (
select *, ({_MULTIPLY.format("k0", "18397679294719823053")})::ubigint k1 from (
select *, {xor.format(f"{key}::ubigint")} k0 from {table})))))"""


def radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_counts(_table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("radix").cast("long").alias("radix"), "n")


def radix_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_counts(_table(spark, sf_dir, "orders"), "o_orderkey", 1).select(F.col("radix").cast("long").alias("radix"), "n")


def radix_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each radix byte, counted in the partitions that they were dealt to, and how many of those it is in: one."""
    dealt = radix_partition(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn("part", F.spark_partition_id())
    return dealt.groupBy(F.col("radix").cast("long").alias("radix")).agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as binary pages of a row each, and decoded."""
    rows = _table(spark, sf_dir, "supplier").select(F.lit("memory").alias("path"), F.col("s_suppkey").cast("int").alias("page_no"), innodb.page_bytes(F.col("s_suppkey"), F.col("s_name")).alias("page"))
    return innodb.rows_of(rows, index_only=True).select("page_no", F.col("slot").cast("long").alias("slot"), F.col("place").cast("long").alias("place"), "score", "board")


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    values = {"checksum": n * 3 + 4_000_000_000, "page_number": n, "prev_page": n + 100, "next_page": n + 200, "lsn": n * 1_000_003 + (1 << 40), "flush_lsn": n + 5, "space_id": F.lit(9)}
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", innodb.page_bytes(n, F.col("n_name"), values).alias("page"))
    fil, own = innodb.fil_header(F.col("page")), innodb.page_header(F.col("page"))
    fields = [fil[name].cast("string").alias(name) for name, _, _ in innodb.FIL_FIELDS if name != "page_type"]
    return rows.select("n_nationkey", *fields, fil["page_type"].cast("long").alias("page_type"), own["n_dir_slots"].cast("long").alias("slots"), F.length("page").cast("long").alias("size"))


def big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("r_name").cast("binary")
    return _table(spark, sf_dir, "region").select("r_regionkey", unsigned(name, 0, 2).cast("long").alias("u16"), unsigned(name, 0, 4).alias("u32"))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", crc32c(F.col("p_name")).alias("crc"), crc32c(F.col("p_name"), final=False).alias("register"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["SELECT m.score FROM marks m, enrollments WHERE subjects.name = 'x'", "select * from a join b on a.k = b.k join c on b.k = c.k", "with x as (select * from t) select * from x where k in (select k from u)", "insert into t values (1)", "delete from t where k = 1", "update t set k = 2"]
    found = [summarize(spark, t) for t in texts]
    return spark.createDataFrame([(k, f.query_type, ",".join(f.table_names)) for k, f in enumerate(found)], "k long, query_type string, tables string")


def plan_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "region").createOrReplaceTempView("region")
    replies = PlanService(spark).apply(["select r_regionkey from region where r_regionkey = 3", "selec 1", "create table t (k int)", "select count(*) n from region"])
    return spark.createDataFrame([(k, r.success, r.message if r.success else "") for k, r in enumerate(replies)], "k long, success boolean, message string")


def ir_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")

    def make() -> DataFrame:
        a, b = ir.load("l_partkey", "I64"), ir.binary("Sub", ir.load("l_suppkey", "I64"), ir.const(50, "I64"))
        small = ir.unary("Trunc", a, "I8")
        x, y = ir.load("l_extendedprice", "F64"), ir.load("l_discount", "F64")
        picked = ir.select(ir.binary("Slt", b, ir.const(0, "I64")), a, b)
        named = {"add": ir.binary("Add", a, b), "rem": ir.binary("SRem", b, ir.const(7, "I64")), "quot": ir.binary("SDiv", b, ir.const(7, "I64")), "small": small, "wide": ir.unary("ZExt", small, "I64"), "shl": ir.binary("Shl", a, ir.const(3, "I64")), "below": ir.binary("Ult", b, a), "zero": ir.binary("FCmpOeq", y, ir.const(0.0, "F64")), "whole": ir.unary("FPToSI", x, "I64"), "picked": picked}
        return rows.select("l_orderkey", "l_linenumber", *[v.column.alias(k) if v.kind == "Bool" else v.column.cast("bigint").alias(k) for k, v in named.items()])

    return wrapping(spark, make)


def ir_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")

    def make() -> DataFrame:
        a, b = ir.load("l_partkey", "I64"), ir.binary("Sub", ir.binary("Mul", ir.load("l_suppkey", "I64"), ir.const(37, "I64")), ir.const(1500, "I64"))
        x, y = ir.load("l_discount", "F64"), ir.load("l_tax", "F64")
        whole = [ir.binary(op, a, b).column.alias(op) for op in ("Eq", "Ne", "Slt", "Sle", "Sgt", "Sge", "Ult", "Ule", "Ugt", "Uge")]
        return rows.select("l_orderkey", "l_linenumber", *whole, *[ir.binary(op, x, y).column.alias(op) for op in ("FCmpOeq", "FCmpOne", "FCmpOlt", "FCmpOle", "FCmpOgt", "FCmpOge")])

    return wrapping(spark, make)


def ir_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")

    def make() -> DataFrame:
        a, b, k = ir.load("l_partkey", "I64"), ir.binary("Sub", ir.binary("Mul", ir.load("l_suppkey", "I64"), ir.const(37, "I64")), ir.const(1500, "I64")), ir.load("l_linenumber", "I64")
        x, y = ir.load("l_extendedprice", "F64"), ir.load("l_quantity", "F64")
        small, nonzero = ir.unary("Trunc", b, "I32"), ir.binary("Add", a, ir.const(1, "I64"))
        named = {op: ir.binary(op, a, b) for op in ("Mul", "And", "Or", "Xor")} | {op: ir.binary(op, b, k) for op in ("AShr", "LShr")}
        named |= {"UDiv": ir.binary("UDiv", b, ir.binary("Mul", nonzero, ir.const(1_000_003, "I64"))), "URem": ir.binary("URem", b, nonzero)} | {op: ir.binary(op, x, y) for op in ("FAdd", "FSub", "FMul", "FDiv", "FRem")}
        named |= {"Neg": ir.unary("Neg", b), "Not": ir.unary("Not", b), "FNeg": ir.unary("FNeg", x), "SExt": ir.unary("SExt", small, "I64"), "SIToFP": ir.unary("SIToFP", b, "F64"), "UIToFP": ir.unary("UIToFP", b, "F64"), "FPToUI": ir.unary("FPToUI", x, "I64"), "FPTrunc": ir.unary("FPExt", ir.unary("FPTrunc", y, "F32"), "F64")}
        return rows.select("l_orderkey", "l_linenumber", *[v.column.alias(name) for name, v in named.items()])

    return wrapping(spark, make)


def school(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven-table star, its tables made from the driver's."""
    t = lambda name: _table(spark, sf_dir, name)
    marks = t("lineitem").select(F.col("l_orderkey").alias("enrollment_id"), F.col("l_quantity").alias("score"))
    enrollments = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 25).alias("classroom_id"))
    students = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("school_id"))
    classrooms = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 4 + 5).alias("grade"))
    assignments = t("supplier").select((F.col("s_suppkey") % 25).alias("classroom_id"), F.col("s_nationkey").alias("subject_id"))
    subjects = t("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") < 2, "Mathematics").otherwise("English").alias("name"))
    schools = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("board"))
    return average_score(marks, enrollments, students, classrooms, assignments, subjects, schools).select("board", F.round("avg_score", 6).alias("avg_score"))


def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(events, "2 hours").select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type", "n", F.round("v", 6).alias("v"))


def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(events, "6 hours").select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n")


QUERIES = {
    "sum_min_max": (sum_min_max, """select l_returnflag, coalesce(sum(l_quantity), 0) as sum, coalesce(min(case when not isnan(l_quantity) then l_quantity end), 'inf'::double) as min,
        coalesce(max(case when not isnan(l_quantity) then l_quantity end), '-inf'::double) as max from lineitem group by 1"""),
    "sum_min_max_empty": (sum_min_max_empty, "select 0.0::double as sum, 'Infinity' as min, '-Infinity' as max"),
    "sum_f64": (total, "select l_linestatus, sum(l_quantity) total from lineitem group by 1"),
    "lookup_join": (lookup, "select c_custkey k, xor(c_nationkey::bigint, b.bp) x from customer join (select o_custkey, max(o_orderkey) bp from orders group by 1) b on c_custkey = b.o_custkey"),
    "asof_join": (asof, "select e.event_id, max(p.ts) t from events e left join events p on e.user_id = p.user_id and p.ts < e.ts group by 1"),
    "hash_mix": (hashes, f"select p_partkey, h from ({_mix_sql('p_partkey', 'part')})"),
    "radix_histogram": (radix, f"select h & 255 radix, count(*) n from ({_mix_sql('o_orderkey', 'orders')}) group by 1"),
    "radix_histogram_pass2": (radix_second, f"select (h >> 8) & 255 radix, count(*) n from ({_mix_sql('o_orderkey', 'orders')}) group by 1"),
    "radix_partition": (radix_whole, f"select h & 255 radix, count(*) n, 1::bigint parts from ({_mix_sql('o_orderkey', 'orders')}) group by 1"),
    "binary_page_rows": (pages, "select s_suppkey::int page_no, 0::bigint slot, 120::bigint place, s_suppkey score, s_name board from supplier"),
    "binary_page_headers": (page_fields, """select n_nationkey, (n_nationkey::bigint * 3 + 4000000000)::varchar checksum, n_nationkey::varchar page_number, (n_nationkey + 100)::varchar prev_page, (n_nationkey + 200)::varchar next_page,
        (n_nationkey::bigint * 1000003 + 1099511627776)::varchar lsn, (n_nationkey + 5)::varchar flush_lsn, '9' space_id, 17855::bigint page_type, 1::bigint slots, 16384::bigint size from nation"""),
    "big_endian": (big_endian, "select r_regionkey, ('0x' || hex(substr(r_name, 1, 2)))::bigint u16, ('0x' || hex(substr(r_name, 1, 4)))::bigint u32 from region"),
    "crc32c": (checksums, _CRC_SQL),
    "join_range": (ranges, "select count(*) n from part p join supplier s on s.s_acctbal between p.p_retailprice and p.p_retailprice + 100"),
    "ir_comparisons": (ir_comparisons, f"""with t as (select *, l_partkey::bigint a, l_suppkey::bigint * 37 - 1500 b, {_U.format("l_partkey::bigint")} ua, {_U.format("(l_suppkey::bigint * 37 - 1500)")} ub, l_discount x, l_tax y from lineitem)
        select l_orderkey, l_linenumber, a = b as Eq, a <> b as Ne, a < b as Slt, a <= b as Sle, a > b as Sgt, a >= b as Sge, ua < ub as Ult, ua <= ub as Ule, ua > ub as Ugt, ua >= ub as Uge,
        x = y as FCmpOeq, x <> y as FCmpOne, x < y as FCmpOlt, x <= y as FCmpOle, x > y as FCmpOgt, x >= y as FCmpOge from t"""),
    "ir_arithmetic": (ir_arithmetic, f"""with t as (select *, l_partkey::bigint a, l_suppkey::bigint * 37 - 1500 b, l_linenumber::bigint k, l_extendedprice x, l_quantity y from lineitem)
        select l_orderkey, l_linenumber, a * b as Mul, a & b as "And", a | b as "Or", xor(a, b) as Xor, b >> k::int as AShr, (({_U.format("b")}) // (2::hugeint ** k::int)::hugeint)::bigint as LShr, (({_U.format("b")}) // ((a + 1) * 1000003))::bigint as UDiv, (({_U.format("b")}) % (a + 1))::bigint as URem,
        x + y as FAdd, x - y as FSub, x * y as FMul, x / y as FDiv, fmod(x, y) as FRem, -b as Neg, -1 - b as "Not", -x as FNeg, b as SExt, b::double as SIToFP, ({_U.format("b")})::double as UIToFP, trunc(x)::bigint as FPToUI, y::float::double as FPTrunc from t"""),
    "statement_summary": (statements, """select * from (values (0::bigint, 'SELECT', 'marks,enrollments'), (1, 'SELECT', 'a,b,c'), (2, 'SELECT', 't,u'), (3, 'INSERT', ''), (4, 'DELETE', ''), (5, 'UPDATE', '')) t(k, query_type, tables)"""),
    "plan_service": (plan_service, """select * from (values (0::bigint, true, '{"r_regionkey":3}'), (1, false, ''), (2, false, ''), (3, true, '{"n":5}')) t(k, success, message)"""),
    "ir_operations": (ir_operations, """with t as (select *, l_partkey::bigint a, l_suppkey::bigint - 50 b, ((l_partkey::bigint & 255) + 128) % 256 - 128 s from lineitem)
        select l_orderkey, l_linenumber, a + b as add, b % 7 as rem, b // 7 as quot, s as small, a & 255 as wide, a * 8 as shl, (b >= 0 and b < a) as below, l_discount = 0 as zero,
        trunc(l_extendedprice)::bigint whole, case when b < 0 then a else b end picked from t"""),
    "school_star": (school, """select s.n_regionkey::varchar board, round(avg(m.l_quantity), 6) avg_score from lineitem m join orders e on m.l_orderkey = e.o_orderkey join customer st on e.o_custkey = st.c_custkey
        join nation c on e.o_orderkey % 25 = c.n_nationkey join supplier a on a.s_suppkey % 25 = c.n_nationkey join nation su on a.s_nationkey = su.n_nationkey join nation s on st.c_nationkey = s.n_nationkey
        where su.n_regionkey < 2 and (c.n_nationkey % 4 + 5)::varchar = '8' group by 1"""),
    "window_tumbling": (window_tumbling, """select strftime(time_bucket(interval '2 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') w, event_type, count(*) n, round(avg(value), 6) v from events group by 1, 2"""),
    "window_sessions": (window_sessions, """with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '6 hours' or lag(ts) over w is null then 1 else 0 end f from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(f) over (partition by user_id order by ts) k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as begin, count(*) n from s group by user_id, k"""),
}
