"""A small typed expression language over columns.

Values have the types of a low-level intermediate representation; operations
have its semantics, not SQL's: integers wrap, unsigned comparisons and divisions
read the same bits another way, float division by zero gives infinities, ordered
comparisons with NaN are false. Frames with these columns are made inside
``operators.radix.wrapping``, which turns errors on overflow off.

Memory, atomics and calling conventions have no meaning for columns: a load is a
column reference, a phi or a branch a ``when``; stores, allocations and atomics
are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = {"I8": 8, "I16": 16, "I32": 32, "I64": 64, "I128": 128}
SQL_TYPE = {"I8": "tinyint", "I16": "smallint", "I32": "int", "I64": "bigint", "I128": "decimal(38,0)", "F32": "float", "F64": "double"}
ATOMICS = ("AtomicRMW", "Cmpxchg", "Store", "Alloca", "PtrToInt", "IntToPtr", "Bitcast")


class IRError(ValueError):
    pass


def spark_type(kind: str, *inner: T.DataType, length: int | None = None) -> T.DataType:
    """The Spark type of a scalar, Vec (numbers only), Struct (fields f0, f1, ...) or Opaque."""
    if kind in SQL_TYPE:
        return T._parse_datatype_string(SQL_TYPE[kind])
    if kind == "Vec":
        if len(inner) != 1 or not isinstance(inner[0], T.NumericType):
            raise IRError("a vector holds integers or floats")
        return T.ArrayType(inner[0], False)
    if kind == "Struct":
        return T.StructType([T.StructField(f"f{k}", t) for k, t in enumerate(inner)])
    if kind == "Opaque":
        return T.BinaryType()
    raise IRError(f"no column type for {kind}")


@dataclass(frozen=True)
class Value:
    """A column with its type; ``Bool`` is what comparisons give."""

    column: Column
    kind: str

    def cast(self, kind: str) -> Value:
        return Value(self.column.cast(SQL_TYPE[kind]), kind)


def load(name: str, kind: str) -> Value:
    return Value(F.col(name).cast(SQL_TYPE[kind]), kind)


def const(value: float, kind: str) -> Value:
    return Value(F.lit(value).cast(SQL_TYPE[kind]), kind)


def undef(kind: str) -> Value:
    return Value(F.lit(None).cast(SQL_TYPE[kind]), kind)


def gep(value: Column, index: int | str) -> Column:
    """A field of a struct or an element of a vector."""
    return value.getField(index) if isinstance(index, str) else value.getItem(index)


def _big(value: int) -> Column:
    """A constant of up to 65 bits."""
    return F.lit(str(value)).cast("decimal(20,0)")


def _wrap(column: Column, kind: str) -> Column:
    """Wide integers back to the type's bits, with sign."""
    if kind == "I64":
        return column
    if kind == "I128":
        return column.cast(SQL_TYPE[kind])
    spare = 64 - WIDTH[kind]
    return F.shiftright(F.shiftleft(column.cast("bigint"), spare), spare).cast(SQL_TYPE[kind])


def _bits(value: Value) -> Column:
    """The type's bits without sign, as a long."""
    if value.kind == "I64":
        return value.column
    return value.column.cast("bigint").bitwiseAND(F.lit((1 << WIDTH[value.kind]) - 1).cast("bigint"))


def _unsigned(value: Value) -> Column:
    """The unsigned reading, as a decimal that holds 64 bits."""
    wide = value.column.cast("decimal(20,0)")
    return F.when(value.column < 0, wide + _big(1 << WIDTH[value.kind])).otherwise(wide).cast("decimal(20,0)")


def _from_unsigned(column: Column, kind: str) -> Column:
    size = _big(1 << WIDTH[kind])
    return F.when(column >= _big(1 << WIDTH[kind] - 1), column - size).otherwise(column).cast(SQL_TYPE[kind])


def _nonzero(column: Column) -> Column:
    return F.when(column != 0, column)


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity with the signs' sign, 0/0 and NaN give NaN."""
    infinite = F.lit(float("inf"))
    # -0.0 = 0.0 in SQL, but its text has a sign
    negative = F.startswith(b.cast("string"), F.lit("-")) != (a < 0)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(negative, -infinite).otherwise(infinite)
    return F.when(b == 0, by_zero).otherwise(a / _nonzero(b))


def _remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")), F.lit(float("nan"))).when(F.abs(b) == float("inf"), a).otherwise(a % _nonzero(b))


def binary(op: str, a: Value, b: Value) -> Value:
    """One of the 34 two-operand operations; the operands have one type.

    A division by integer zero, and a shift by the width or more, give null.
    """
    if a.kind != b.kind:
        raise IRError(f"{op}: {a.kind} and {b.kind} differ")
    kind, x, y = a.kind, a.column, b.column
    if kind in WIDTH and kind != "I128" and op in ("Add", "Sub", "Mul"):
        wide_x, wide_y = x.cast("bigint"), y.cast("bigint")
        return Value(_wrap({"Add": wide_x + wide_y, "Sub": wide_x - wide_y, "Mul": wide_x * wide_y}[op], kind), kind)
    if kind == "I128" and op in ("Add", "Sub", "Mul"):
        return Value({"Add": x + y, "Sub": x - y, "Mul": x * y}[op].cast(SQL_TYPE[kind]), kind)
    if kind in WIDTH:
        if op in ("Eq", "Ne", "Slt", "Sle", "Sgt", "Sge"):
            return Value({"Eq": x == y, "Ne": x != y, "Slt": x < y, "Sle": x <= y, "Sgt": x > y, "Sge": x >= y}[op], "Bool")
        if kind == "I128":
            if op not in ("SDiv", "SRem"):
                raise IRError(f"{op} has no {kind} form")
            quotient = F.call_function("div", x, _nonzero(y)) if op == "SDiv" else x % _nonzero(y)
            return Value(quotient.cast(SQL_TYPE[kind]), kind)
        if op in ("Ult", "Ule", "Ugt", "Uge"):
            low = F.lit(-(1 << 63)).cast("bigint")
            u, v = _bits(a).bitwiseXOR(low), _bits(b).bitwiseXOR(low)
            return Value({"Ult": u < v, "Ule": u <= v, "Ugt": u > v, "Uge": u >= v}[op], "Bool")
        if op in ("SDiv", "SRem"):
            wide_x, wide_y = x.cast("decimal(20,0)"), _nonzero(y.cast("decimal(20,0)"))
            if op == "SRem":
                return Value((wide_x % wide_y).cast(SQL_TYPE[kind]), kind)
            quotient = (wide_x - wide_x % wide_y) / wide_y
            return Value(_wrap(_low64(quotient.cast("decimal(20,0)")), kind), kind)
        if op in ("UDiv", "URem"):
            u, v = _unsigned(a), _nonzero(_unsigned(b))
            rest = (u % v).cast("decimal(20,0)")
            found = rest if op == "URem" else ((u - rest) / v).cast("decimal(20,0)")
            return Value(_from_unsigned(found, kind), kind)
        if op in ("And", "Or", "Xor"):
            return Value({"And": x.bitwiseAND(y), "Or": x.bitwiseOR(y), "Xor": x.bitwiseXOR(y)}[op], kind)
        if op in ("Shl", "LShr", "AShr"):
            fine = (y >= 0) & (y < WIDTH[kind])
            by = y.cast("int")
            wide = x.cast("bigint")
            moved = {"Shl": F.call_function("shiftleft", wide, by), "LShr": F.call_function("shiftrightunsigned", _bits(a), by), "AShr": F.call_function("shiftright", wide, by)}[op]
            return Value(F.when(fine, _wrap(moved, kind)), kind)
    if kind in ("F32", "F64"):
        if op in ("FAdd", "FSub", "FMul"):
            return Value({"FAdd": x + y, "FSub": x - y, "FMul": x * y}[op].cast(SQL_TYPE[kind]), kind)
        if op in ("FDiv", "FRem"):
            return Value((_divide(x, y) if op == "FDiv" else _remainder(x, y)).cast(SQL_TYPE[kind]), kind)
        if op in ("FCmpOeq", "FCmpOne", "FCmpOlt", "FCmpOle", "FCmpOgt", "FCmpOge"):
            holds = {"FCmpOeq": x == y, "FCmpOne": x != y, "FCmpOlt": x < y, "FCmpOle": x <= y, "FCmpOgt": x > y, "FCmpOge": x >= y}[op]
            return Value(holds & ~F.isnan(x) & ~F.isnan(y), "Bool")
    raise IRError(f"{op} has no {kind} form")


def _low64(column: Column) -> Column:
    """A decimal of up to 65 bits as the long with its low 64: 2^63 wraps to the smallest."""
    return F.when(column == _big(1 << 63), F.lit(-(1 << 63)).cast("bigint")).otherwise(column.cast("bigint"))


def unary(op: str, a: Value, to: str | None = None) -> Value:
    """One of the one-operand operations and conversions; conversions name their type.

    A float that the integer type can't hold converts to null.
    """
    if op in ATOMICS:
        raise IRError(f"{op} has no column form")
    x = a.column
    if op == "Neg" and a.kind in WIDTH:
        return binary("Sub", const(0, a.kind), a)
    if op == "Not" and a.kind in WIDTH and a.kind != "I128":
        return Value(F.bitwise_not(x), a.kind)
    if op == "FNeg" and a.kind in ("F32", "F64"):
        return Value(-x, a.kind)
    if to is None:
        raise IRError(f"{op} has no {a.kind} form")
    if op == "Trunc" and WIDTH[to] < WIDTH[a.kind] <= 64:
        return Value(_wrap(x, to), to)
    if op == "ZExt" and WIDTH[to] > WIDTH[a.kind]:
        return Value(_unsigned(a).cast(SQL_TYPE[to]) if a.kind == "I64" else _bits(a).cast(SQL_TYPE[to]), to)
    if op == "SExt" and WIDTH[to] > WIDTH[a.kind] or op in ("FPExt", "FPTrunc") and {a.kind, to} == {"F32", "F64"} or op == "SIToFP" and a.kind in WIDTH:
        return a.cast(to)
    if op == "UIToFP" and a.kind in WIDTH:
        return Value(_unsigned(a).cast(SQL_TYPE[to]), to)
    if op in ("FPToSI", "FPToUI") and a.kind in ("F32", "F64") and WIDTH[to] <= 64:
        bits = WIDTH[to]
        wide = x.cast("double")
        low, high = (-(2.0 ** (bits - 1)), 2.0 ** (bits - 1)) if op == "FPToSI" else (0.0, 2.0**bits)
        inside = ~F.isnan(wide) & (wide < high) & (wide > low - 1.0 if low > -(2.0**53) else wide >= low)
        if op == "FPToSI":
            return Value(F.when(inside, wide).cast(SQL_TYPE[to]), to)
        half = F.when(inside & (wide >= 2.0**63), (wide - 2.0**63).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))).otherwise(F.when(inside, wide).cast("bigint"))
        return Value(_wrap(half, to), to)
    raise IRError(f"{op} from {a.kind} to {to} has no column form")


def select(condition: Value, yes: Value, no: Value) -> Value:
    """A branch, or the phi behind it."""
    if yes.kind != no.kind:
        raise IRError("both ways need one type")
    return Value(F.when(condition.column, yes.column).otherwise(no.column), yes.kind)


def switch(value: Value, cases: Sequence[tuple[int, Value]], default: Value) -> Value:
    if not cases:
        return default
    found = F
    for case, result in cases:
        found = found.when(value.column == case, result.column)
    return Value(found.otherwise(default.column), default.kind)


def call(name: str, kind: str, *arguments: Value) -> Value:
    """A registered or built-in function."""
    return Value(F.call_function(name, *[a.column for a in arguments]).cast(SQL_TYPE[kind]), kind)
