"""Scalar math."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import ieee_log, ieee_sqrt

UNARY = {
    "exp": F.exp, "log": ieee_log, "sqrt": ieee_sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "negate": lambda c: -c, "not": lambda c: ~c, "abs": F.abs,
}


def erf(c: Column) -> Column:
    """The error function, which Spark lacks, to within 2e-16 of 1: its power series below 3, the continued fraction of
    its complement above. Both are plain expressions, so they stay in the JVM."""
    x = F.abs(c.cast("double"))
    near, far = F.least(x, F.lit(3.0)), F.greatest(x, F.lit(3.0))
    # sum of 2**n x**(2n+1) / (1 * 3 * ... * (2n + 1)), from its last term
    terms = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    series = F.aggregate(terms, F.lit(1.0), lambda s, n: 1.0 + s * (2.0 * near * near) / (2.0 * n + 1.0))
    low = F.lit(2 / math.sqrt(math.pi)) * near * F.exp(-near * near) * series
    fraction = F.aggregate(terms, far, lambda s, n: far + (n / 2.0) / s)
    high = 1.0 - F.exp(-far * far) / (fraction * math.sqrt(math.pi))
    size = F.when(x < 3.0, low).otherwise(high)
    return F.when(F.isnan(x), x).when(c.cast("double") < 0, -size).otherwise(size)


UNARY["erf"] = erf


def power(a: Column, b: Column, single: bool = False) -> Column:
    out = F.pow(a, b)
    return out.cast("float") if single else out


def bit(op: str, a: Column, b: Column, boolean: bool = False) -> Column:
    if boolean:
        return {"&": a & b, "|": a | b, "^": a != b}[op]
    return {"&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b)}[op]


def least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def select(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the natural order of numbers, strings, structs and arrays."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def integer(text: str) -> Column:
    """Literals like 0xff, 0b101 and 42."""
    return F.lit(int(text, 0))


def iterate(start: Column, step, done, most: int = 1000) -> Column:
    """The state after stepping until done(state); it steps at least once, and no more than `most` times."""
    state = F.struct(start.alias("s"), F.lit(False).alias("end"))

    def one(acc, _):
        new = step(acc["s"])
        return F.struct(F.when(acc["end"], acc["s"]).otherwise(new).alias("s"), (acc["end"] | done(new)).alias("end"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, one)
    return F.when(out["end"], out["s"]).otherwise(F.raise_error(F.lit("iterate: no end")))
