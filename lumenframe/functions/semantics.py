"""Numeric semantics that differ from Spark's defaults: wrapping integers, IEEE comparison and division, identities and
type promotion. All are Column expressions; the session's configuration is never changed."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NumPy type name -> Spark type. Spark has no unsigned integers: they live in the next wider signed type.
TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType(),
}
NAN, INF = float("nan"), float("inf")


def promote(left: str, right: str) -> str:
    """The type both operands of a binary operator are brought to: NumPy's rules."""
    return np.promote_types(left, right).name


def is_float(name: str) -> bool:
    return name.startswith("float")


def bits(name: str) -> int:
    return np.dtype(name).itemsize * 8


def _big(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def wrap(c: Column, name: str) -> Column:
    """An integer brought into the range of `name` by two's complement wrapping."""
    n = bits(name)
    wide = c.cast("decimal(38,0)")
    mod = _big(1 << n)
    if name.startswith("u"):
        out = F.pmod(wide, mod)
    else:
        half = _big(1 << (n - 1))
        out = F.pmod(wide + half, mod) - half
    return out.cast(TYPES[name])


def wrap_add(a: Column, b: Column, name: str) -> Column:
    return wrap(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), name)


def wrap_sub(a: Column, b: Column, name: str) -> Column:
    return wrap(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"), name)


def wrap_mul(a: Column, b: Column, name: str) -> Column:
    """For operands of up to 32 bits the product is exact; 64-bit ones are multiplied by halves, modulo 2**64."""
    if bits(name) <= 32:
        return wrap(a.cast("decimal(20,0)") * b.cast("decimal(18,0)"), name)
    two32 = _big(1 << 32)
    a, b = F.pmod(a.cast("decimal(38,0)"), _big(1 << 64)), F.pmod(b.cast("decimal(38,0)"), _big(1 << 64))
    low = lambda x: F.pmod(x, two32).cast("decimal(10,0)")
    high = lambda x: ((x - F.pmod(x, two32)) / two32).cast("decimal(10,0)")
    cross = F.pmod((high(a) * low(b)).cast("decimal(38,0)") + (low(a) * high(b)).cast("decimal(38,0)"), two32).cast("decimal(11,0)")
    return wrap((cross * two32.cast("decimal(11,0)")).cast("decimal(38,0)") + (low(a) * low(b)).cast("decimal(38,0)"), name)


def wrap_cast(c: Column, name: str, source: str) -> Column:
    """A C-like cast: integers keep their low bits, floats are cut toward zero, anything but 0 is true."""
    if name == "bool":
        return c.cast("double") != 0
    if is_float(name):
        return c.cast(TYPES[name])
    if source == "bool":
        return c.cast("int").cast(TYPES[name])
    if is_float(source):
        whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        return wrap(whole, name)
    return wrap(c, name)


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers of up to 64 bits, cut toward zero; a zero divisor raises. The least integer by -1 wraps."""
    least = F.lit(-(1 << 63)).cast("bigint")
    a = a.cast("bigint")
    return F.when((a == least) & (b == -1), least).otherwise(F.call_function("div", a, b.cast("bigint")))


def float_div(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is an infinity, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend."""
    return a % b


COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def ieee_compare(op: str, a: Column, b: Column) -> Column:
    """Ordered comparison: false whenever either side is NaN."""
    return COMPARE[op](a, b) & ~F.isnan(a) & ~F.isnan(b)


def ieee_log(c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.isnan(c) | (c < 0), F.lit(NAN)).when(c == 0, F.lit(-INF)).otherwise(F.log(F.when(c > 0, c)))


def ieee_sqrt(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c < 0, F.lit(NAN)).otherwise(F.sqrt(c))


def identity(op: str, name: str):
    """What an empty reduction yields: 0, 1, the type's largest value for min and its smallest for max."""
    if op in ("+", "*"):
        return {"+": 0, "*": 1}[op]
    if is_float(name):
        top = float(np.finfo(name).max)
        return top if op == "min" else -top
    info = np.iinfo(name)
    return int(info.max if op == "min" else info.min)


def or_identity(agg: Column, op: str, name: str) -> Column:
    return F.coalesce(agg, F.lit(identity(op, name)).cast(TYPES[name]))


def sample_moment(agg: Column) -> Column:
    """Sample variance or deviation with 0 / 0 = NaN for a single row."""
    return F.when(F.count(F.lit(1)) == 1, F.lit(NAN)).otherwise(agg)


def require(condition: Column, value: Column, message: str = "assertion failed") -> Column:
    """value, or a failed run if the condition doesn't hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
