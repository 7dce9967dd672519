"""Sinks: pandas and NumPy results, plan dumps, and the packed byte format.

Packed bytes: numbers little-endian in their own width, booleans one byte, arrays a 64-bit length and then their
elements, structs their fields in order, maps a 64-bit length and then keys and values in the order of the keys.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .read import POS

#: struct codes by Spark type.
CODES = {T.BooleanType: "?", T.ByteType: "b", T.ShortType: "h", T.IntegerType: "i", T.LongType: "q", T.FloatType: "f", T.DoubleType: "d"}


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """All columns, lazily attached ones too, in the order of positions where there are any."""
    if POS in df.columns:
        df = df.orderBy(POS).drop(POS)
    return df.toPandas()


def to_numpy(df: DataFrame, column: str) -> np.ndarray:
    return to_pandas(df.select(*[c for c in (POS, column) if c in df.columns]))[column].to_numpy()


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pack(value, kind: T.DataType) -> bytes:
    if type(kind) in CODES:
        return struct.pack("<" + CODES[type(kind)], value)
    if isinstance(kind, T.StringType):
        b = value.encode()
        return struct.pack("<q", len(b)) + b
    if isinstance(kind, T.ArrayType) and type(kind.elementType) in CODES:
        return struct.pack("<q", len(value)) + np.asarray(value, "<" + CODES[type(kind.elementType)]).tobytes()
    if isinstance(kind, T.ArrayType):
        return struct.pack("<q", len(value)) + b"".join(pack(v, kind.elementType) for v in value)
    if isinstance(kind, T.MapType):
        return struct.pack("<q", len(value)) + b"".join(pack(k, kind.keyType) + pack(value[k], kind.valueType) for k in sorted(value))
    if isinstance(kind, T.StructType):
        return b"".join(pack(value[f.name], f.dataType) for f in kind)
    raise TypeError(kind)


def unpack(b: bytes, kind: T.DataType):
    value, at = _unpack(b, 0, kind)
    if at != len(b):
        raise ValueError(f"{len(b) - at} bytes are left over")
    return value


def _unpack(b: bytes, at: int, kind: T.DataType):
    if type(kind) in CODES:
        code = "<" + CODES[type(kind)]
        return struct.unpack_from(code, b, at)[0], at + struct.calcsize(code)
    if isinstance(kind, T.StructType):
        out = {}
        for f in kind:
            out[f.name], at = _unpack(b, at, f.dataType)
        return out, at
    n = struct.unpack_from("<q", b, at)[0]
    at += 8
    if isinstance(kind, T.StringType):
        return b[at : at + n].decode(), at + n
    if isinstance(kind, T.ArrayType) and type(kind.elementType) in CODES:
        item = np.dtype("<" + CODES[type(kind.elementType)])
        if at + n * item.itemsize > len(b):
            raise ValueError("bytes are missing")
        return np.frombuffer(b, item, n, at).tolist(), at + n * item.itemsize
    if isinstance(kind, T.ArrayType):
        out = []
        for _ in range(n):
            v, at = _unpack(b, at, kind.elementType)
            out.append(v)
        return out, at
    if isinstance(kind, T.MapType):
        out = {}
        for _ in range(n):
            k, at = _unpack(b, at, kind.keyType)
            out[k], at = _unpack(b, at, kind.valueType)
        return out, at
    raise TypeError(kind)


def _plain(v, kind: T.DataType):
    """Arrays of arrays as lists; arrays of numbers stay as they are."""
    nested = isinstance(kind, T.ArrayType) and type(kind.elementType) not in CODES
    return [_plain(x, kind.elementType) for x in v] if nested and isinstance(v, np.ndarray) else v


def serialize(c: Column, kind: T.DataType) -> Column:
    """Packed bytes of a column of the given type."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: pack(_plain(v, kind), kind))

    return run(c)


def deserialize(c: Column, kind: T.DataType) -> Column:
    """The value of packed bytes, which must be used up exactly."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: unpack(bytes(b), kind))

    return run(c)
