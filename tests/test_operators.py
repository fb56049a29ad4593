import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import ir
from quillon.functions.checksum import crc32c, crc32c_bytes, crc32c_rows
from quillon.operators.aggregate import aggregate_f64, total_f64
from quillon.operators.lookup_join import asof_join, lookup_join, range_join
from quillon.operators.radix import mix, mix_int, radix_counts, radix_partition, wrapping
from quillon.operators.star import average_score

INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    ("values", "expected"),
    [([1, 2, 3, 4, 5], (15, 1, 5)), ([], (0, INF, -INF)), ([NAN, 1.0], (NAN, 1, 1)), ([NAN], (NAN, INF, -INF)), ([INF, -INF], (NAN, -INF, INF)), ([None, 2.0], (2, 2, 2)), *[(list(range(n)), (n * (n - 1) / 2, 0, n - 1)) for n in (31, 32, 33)]],
)
def test_sum_min_max(spark, values, expected):
    frame = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    row = aggregate_f64(frame, "x").first()
    assert [repr(float(v)) for v in row] == [repr(float(v)) for v in expected]
    assert repr(frame.agg(total_f64("x")).first()[0]) == repr(float(expected[0]))


def test_lookup_join_vector(spark):
    build = spark.createDataFrame([(1, 10, 0), (1, 12, 1), (2, 7, 2), (None, 5, 3)], "key long, payload long, ord long")
    probe = spark.createDataFrame([(1, 3), (1, 4), (3, 9), (2, 5), (None, 1)], "key long, payload long")
    assert sorted(map(tuple, lookup_join(probe, build, "key", "payload", "ord").collect())) == [(1, 8), (1, 15), (2, 2)]
    assert lookup_join(probe.limit(0), build, "key", "payload", "ord").count() == 0
    assert lookup_join(probe, build.limit(0), "key", "payload", "ord").count() == 0


def test_lookup_join_against_a_model(spark):
    r = random.Random(4)
    build = [(r.randint(-5, 5), r.randint(-99, 99), k) for k in range(60)]
    probe = [(r.randint(-8, 8), r.randint(-99, 99)) for _ in range(80)]
    last = {}
    for key, payload, _ in build:
        last[key] = payload
    expected = sorted((k, p ^ last[k]) for k, p in probe if k in last)
    found = lookup_join(spark.createDataFrame(probe, "key long, payload long"), spark.createDataFrame(build, "key long, payload long, ord long"), "key", "payload", "ord")
    assert sorted(map(tuple, found.collect())) == expected


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("c", 9), (None, 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 5, 50)], "k string, t int, v int")
    strict = {(r.k, r.t): r.found for r in asof_join(left, right, "k", "t", "v").collect()}
    assert strict == {("a", 1): None, ("a", 5): 40, ("b", 5): None, ("c", 9): None, (None, 2): None}
    loose = {(r.k, r.t): r.found for r in asof_join(left, right, "k", "t", "v", strict=False).collect()}
    assert loose == {("a", 1): 10, ("a", 5): 40, ("b", 5): 50, ("c", 9): None, (None, 2): None}


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_in_buckets_is_the_same(spark, strict):
    r = random.Random(3)
    left = spark.createDataFrame([(r.choice("abc"), r.randint(-50, 50), k) for k in range(150)] + [(None, 4, 999)], "k string, t int, n int")
    right = spark.createDataFrame([(r.choice("abd"), t, t * 10 if t % 7 else None) for t in r.sample(range(-60, 60), 40)], "k string, t int, v int")
    whole = sorted(map(repr, asof_join(left, right, "k", "t", "v", strict).collect()))
    for bucket in (1.0, 7.0, 1000.0):
        assert sorted(map(repr, asof_join(left, right, "k", "t", "v", strict, bucket).collect())) == whole


def test_range_join_is_every_pair_in_range(spark):
    r = random.Random(5)
    left = [(k, x := r.uniform(-30, 30), x + r.uniform(-1, 15)) for k in range(60)]
    right = [(k, r.choice([r.uniform(-40, 40), float(r.randint(-40, 40))])) for k in range(80)] + [(99, None)]
    frames = spark.createDataFrame([*left, (98, None, 1.0)], "a int, x double, y double"), spark.createDataFrame(right, "b int, z double")
    found = range_join(*frames, F.col("x"), F.col("y"), F.col("z"), 5.0).select("a", "b").collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a, x, y in left for b, z in right if z is not None and x <= z <= y)


def test_star_counts_a_mark_for_each_assignment(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    marks = one([(1, 10.0), (2, 40.0), (2, None)], "enrollment_id int, score double")
    found = average_score(marks, one([(1, 1, 1), (2, 1, 2)], "id int, student_id int, classroom_id int"), one([(1, 1)], "id int, school_id int"), one([(1, 8), (2, 8)], "id int, grade int"),
                          one([(1, 5), (1, 5), (1, 5), (2, 5)], "classroom_id int, subject_id int"), one([(5, "Mathematics")], "id int, name string"), one([(1, "b")], "id int, board string"))
    assert found.first().avg_score == (3 * 10 + 40) / 4


def test_crc32c_of_many_rows():
    r = random.Random(2)
    rows = [None if r.random() < 0.1 else r.randbytes(r.choice([0, 1, 7, 60])) for _ in range(200)]
    assert crc32c_rows(rows) == [None if d is None else crc32c_bytes(d) for d in rows] and crc32c_rows([]) == [] and crc32c_rows([None]) == [None]


def test_hash_vectors(spark):
    keys = [1, 2, 3, 4, 5, 0, -1, 2**63 - 1, -(2**63), 123456789012345]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    mode = spark.conf.get("spark.sql.ansi.enabled")
    found = [r[0] for r in wrapping(spark, lambda: frame.select(mix(F.col("k")))).collect()]
    assert found[:5] == [2157213648, 1606003143, 44652811, 4016053277, 52855362]
    assert found == [mix_int(k) for k in keys]
    assert spark.conf.get("spark.sql.ansi.enabled") == mode


def test_radix(spark):
    frame = spark.range(500).withColumnRenamed("id", "k")
    expected = {}
    for k in range(500):
        expected[mix_int(k) & 255] = expected.get(mix_int(k) & 255, 0) + 1
    assert {r.radix: r.n for r in radix_counts(frame, "k").collect()} == expected
    dealt = radix_partition(frame, "k").withColumn("part", F.spark_partition_id())
    assert dealt.groupBy("radix").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_crc32c(spark):
    assert crc32c_bytes(b"123456789") == 0xE3069283
    assert crc32c_bytes(b"123456789", final=False) == 0x1CF96D7C
    frame = spark.createDataFrame([("123456789",), ("",), (None,)], "s string")
    assert [tuple(r) for r in frame.select(crc32c(F.col("s")), crc32c(F.col("s"), final=False)).collect()] == [(0xE3069283, 0x1CF96D7C), (0, 0xFFFFFFFF), (None, None)]


def test_star_fan_out_and_grades(spark):
    make = spark.createDataFrame
    marks = make([(1, 80.0), (1, None), (2, 60.0), (9, 1.0)], "enrollment_id long, score double")
    enrollments = make([(1, 11, 21), (2, 12, 22), (3, 13, 21)], "id long, student_id long, classroom_id long")
    students = make([(11, 31), (12, 32), (13, 31)], "id long, school_id long")
    assignments = make([(21, 41), (21, 42), (21, 43), (22, 41)], "classroom_id long, subject_id long")
    subjects = make([(41, "Mathematics"), (42, "Mathematics"), (43, "English")], "id long, name string")
    schools = make([(31, "CBSE"), (32, "0")], "id long, board string")
    for rooms in (make([(21, "8"), (22, "K")], "id long, grade string"), make([(21, 8), (22, 8)], "id long, grade int")):
        found = dict(map(tuple, average_score(marks, enrollments, students, rooms, assignments, subjects, schools).collect()))
        assert found == ({"CBSE": 80.0} if rooms.schema["grade"].dataType == T.StringType() else {"CBSE": 80.0, "0": 60.0})
    assert average_score(marks, enrollments, students, rooms, assignments, subjects, schools, "Art").count() == 0


def _signed(v, bits):
    v &= (1 << bits) - 1
    return v - (1 << bits) if v >> bits - 1 else v


def _int_model(op, a, b, bits):
    u, v, full = a % (1 << bits), b % (1 << bits), 1 << bits
    if op in ("SDiv", "SRem", "UDiv", "URem") and b == 0 or op in ("Shl", "LShr", "AShr") and not 0 <= b < bits:
        return None
    quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1) if b else 0
    table = {"Add": lambda: a + b, "Sub": lambda: a - b, "Mul": lambda: a * b, "SDiv": lambda: quotient, "SRem": lambda: a - quotient * b, "UDiv": lambda: u // v, "URem": lambda: u % v, "And": lambda: a & b, "Or": lambda: a | b, "Xor": lambda: a ^ b, "Shl": lambda: a << b, "LShr": lambda: u >> b, "AShr": lambda: a >> b}
    if op in table:
        return _signed(table[op]() % full, bits)
    return {"Eq": a == b, "Ne": a != b, "Slt": a < b, "Sle": a <= b, "Sgt": a > b, "Sge": a >= b, "Ult": u < v, "Ule": u <= v, "Ugt": u > v, "Uge": u >= v}[op]


INT_OPS = "Add Sub Mul SDiv SRem UDiv URem And Or Xor Shl LShr AShr Eq Ne Slt Sle Sgt Sge Ult Ule Ugt Uge".split()


@pytest.mark.parametrize("kind", ["I8", "I16", "I32", "I64"])
def test_integer_operations(spark, kind):
    bits = ir.WIDTH[kind]
    r = random.Random(bits)
    edge = [0, 1, -1, 3, 7, -7, -(1 << bits - 1), (1 << bits - 1) - 1]
    pairs = [(a, b) for a in edge for b in edge] + [(r.randint(-(1 << bits - 1), (1 << bits - 1) - 1), r.randint(0, bits + 2)) for _ in range(30)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "n int, a long, b long")
    made = wrapping(spark, lambda: frame.select("n", *[ir.binary(op, ir.load("a", kind), ir.load("b", kind)).column.alias(op) for op in INT_OPS]))
    for row in made.collect():
        a, b = pairs[row.n]
        assert {op: row[op] for op in INT_OPS} == {op: _int_model(op, a, b, bits) for op in INT_OPS}, (a, b)


def test_float_operations(spark):
    values = [0.0, -0.0, 1.5, -2.5, INF, -INF, NAN]
    pairs = [(a, b) for a in values for b in values]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "n int, a double, b double")
    ops = ["FDiv", "FRem", "FCmpOeq", "FCmpOne", "FCmpOlt", "FCmpOge", "FAdd"]
    made = wrapping(spark, lambda: frame.select("n", *[ir.binary(op, ir.load("a", "F64"), ir.load("b", "F64")).column.alias(op) for op in ops]))

    def divide(a, b):
        if b == 0:
            return NAN if a == 0 or math.isnan(a) else math.copysign(INF, math.copysign(1, a) * math.copysign(1, b))
        return a / b

    def rest(a, b):
        return NAN if b == 0 or math.isnan(a) or math.isnan(b) or math.isinf(a) else math.fmod(a, b)

    for row in made.collect():
        a, b = pairs[row.n]
        same = lambda x, y: x == y or (math.isnan(x) and math.isnan(y))
        assert same(row.FDiv, divide(a, b)), (a, b, row.FDiv)
        assert same(row.FRem, rest(a, b)), (a, b, row.FRem)
        assert same(row.FAdd, a + b)
        ordered = not (math.isnan(a) or math.isnan(b))
        assert (row.FCmpOeq, row.FCmpOne, row.FCmpOlt, row.FCmpOge) == (a == b, ordered and a != b, a < b, a >= b)


def test_conversions_and_control(spark):
    frame = spark.createDataFrame([(300, -1, 2.9)], "a long, b long, x double")

    def make():
        a, b, x = ir.load("a", "I64"), ir.load("b", "I64"), ir.load("x", "F64")
        byte = ir.unary("Trunc", a, "I8")
        cases = {
            "trunc": byte, "zext": ir.unary("ZExt", ir.unary("Trunc", b, "I8"), "I64"), "sext": ir.unary("SExt", ir.unary("Trunc", b, "I8"), "I64"), "neg": ir.unary("Neg", a), "not": ir.unary("Not", a),
            "tosi": ir.unary("FPToSI", ir.unary("FNeg", x), "I32"), "toui": ir.unary("FPToUI", ir.const(1.2e19, "F64"), "I64"), "nan": ir.unary("FPToSI", ir.const(NAN, "F64"), "I64"), "si": ir.unary("SIToFP", b, "F64"), "ui": ir.unary("UIToFP", b, "F64"),
            "pick": ir.select(ir.binary("Slt", a, b), a, b), "switch": ir.switch(a, [(300, ir.const(1, "I32")), (2, ir.const(2, "I32"))], ir.const(0, "I32")), "call": ir.call("abs", "I64", b), "undef": ir.undef("I32"),
            "wide": ir.binary("Mul", ir.load("a", "I128"), ir.load("a", "I128")),
        }
        return frame.select(*[v.column.alias(k) for k, v in cases.items()])

    row = wrapping(spark, make).first().asDict()
    assert row == {"trunc": 44, "zext": 255, "sext": -1, "neg": -300, "not": -301, "tosi": -2, "toui": _signed(int(1.2e19), 64), "nan": None, "si": -1.0, "ui": 18446744073709551615.0, "pick": -1, "switch": 1, "call": 1, "undef": None, "wide": 90000}


def test_ir_types_and_refusals():
    assert ir.spark_type("Struct", T.IntegerType(), T.StringType()).simpleString() == "struct<f0:int,f1:string>"
    assert ir.spark_type("Vec", T.FloatType()).simpleString() == "array<float>"
    for wrong in (lambda: ir.spark_type("Vec", T.StringType()), lambda: ir.spark_type("Ptr")):
        with pytest.raises(ir.IRError):
            wrong()


def test_ir_refuses_memory_and_mixed_types(spark):
    a = ir.const(1, "I32")
    for wrong in (lambda: ir.unary("AtomicRMW", a), lambda: ir.binary("Add", a, ir.const(1, "I64")), lambda: ir.binary("FAdd", a, a), lambda: ir.select(a, a, ir.const(1.0, "F64"))):
        with pytest.raises(ir.IRError):
            wrong()
