"""The NumPy-like surface: Array, a lazy vector that NumPy's functions work on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.read import POS
from . import relational as R
from .frame import Series

#: NumPy functions and the methods of Series that compute them.
BINARY = {np.add: "add", np.subtract: "sub", np.multiply: "mul", np.true_divide: "div", np.remainder: "mod", np.equal: "eq", np.not_equal: "ne", np.less: "lt", np.less_equal: "le", np.greater: "gt", np.greater_equal: "ge"}
UNARY = {np.exp: "exp", np.log: "log", np.sqrt: "sqrt", np.sin: "sin", np.cos: "cos", np.tan: "tan", np.arcsin: "asin", np.arccos: "acos", np.arctan: "atan", np.sinh: "sinh", np.cosh: "cosh", np.tanh: "tanh"}
REDUCE = {np.add: "sum", np.multiply: "prod", np.minimum: "min", np.maximum: "max"}


def array(data, dtype: str | None = None) -> Array:
    return Array(Series(np.asarray(data), dtype))


class Array(np.lib.mixins.NDArrayOperatorsMixin):
    """A one-dimensional vector. Element-wise functions and reductions run lazily on Spark; other NumPy functions get
    the evaluated values.

    A slice is a view: writing to it writes to the array it was taken from. Writes replace the lazy values; the data they
    were read from never changes.
    """

    def __init__(self, values: Series, base: Array | None = None, start: int = 0, stop: int | None = None):
        self._values, self._base, self._start, self._stop = values, base, start, stop

    @property
    def series(self) -> Series:
        return self._values if self._base is None else self._base.series[self._start : self._stop]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.series.dtype)

    def __len__(self) -> int:
        return self.series.df.count()

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.asarray(self.series.evaluate().to_numpy(), dtype or self.dtype)

    evaluate = __array__

    def __array_ufunc__(self, f, method, *inputs, out=None, **options):
        given = [x.series if isinstance(x, Array) else x for x in inputs]
        if method == "reduce" and f in REDUCE and not set(options) - {"axis", "keepdims"} and not options.get("keepdims"):
            return self.dtype.type(given[0].agg(REDUCE[f]))
        if method == "__call__" and not options:
            got = None
            if f in UNARY:
                got = given[0].math(UNARY[f])
            elif f in BINARY and all(isinstance(x, (Series, int, float, np.generic)) for x in given):
                a, b = given
                got = getattr(a if isinstance(a, Series) else Series._of_scalar(b, a), BINARY[f])(b)
            if got is not None:
                if out is None:
                    return Array(got)
                out[0]._write(lambda s: got.astype(s.dtype), 0, None)
                return out[0]
        plain = [np.asarray(x) if isinstance(x, Array) else x for x in inputs]
        if out is not None:
            raise TypeError(f"{f.__name__} cannot write into an Array")
        return getattr(f, method)(*plain, **options)

    def __getitem__(self, k):
        if isinstance(k, slice):
            start, stop, step = k.indices(len(self))
            if step != 1:
                raise ValueError("views have no step")
            return Array(self._values, self, start, max(start, stop))
        s = self.series
        if isinstance(k, Array) and k.dtype == bool:
            return Array(s[k.series])
        if isinstance(k, (list, np.ndarray, Array)):
            return Array(self._gathered(s, k))
        k = int(k)
        return self.dtype.type(s[k if k >= 0 else k + len(self)])

    def _gathered(self, s: Series, k) -> Series:
        """Elements at positions, in their order: a join by position."""
        at = (k.series if isinstance(k, Array) else Series(np.asarray(k, np.int64)))
        wanted = at.df.select(F.col(POS).alias("__to"), at.column.alias(POS))
        got = wanted.join(s.df.select(POS, s.column.alias(s.name)), POS, "left")
        found = S.require(F.col(s.name).isNotNull(), F.col(s.name), "position out of range")
        return s._new(F.col(s.name), s.dtype, got.select(F.col("__to").alias(POS), found.alias(s.name)))

    def __setitem__(self, k, value) -> None:
        if isinstance(k, slice):
            start, stop, step = k.indices(len(self))
            if step != 1:
                raise ValueError("views have no step")
            self._write(self._filler(value, start), start, stop)
        elif isinstance(k, (list, np.ndarray)):
            at = [int(i) for i in np.asarray(k)]
            new = list(np.broadcast_to(np.asarray(value), len(at)))
            last = dict(zip(at, new, strict=True))  # a position that occurs again takes its last value
            updates = Series(np.asarray(list(last.values()), self.dtype))
            df = updates.df.select(F.lit(None).alias("x"), F.col(POS), updates.column.alias("__v")).drop("x")
            where = Series(np.asarray(list(last), np.int64))
            df = R.zip_join(df, where.df.select(POS, where.column.alias("__p"))).select(F.col("__p").alias(POS), "__v")
            self._merge(df)
        else:
            k = int(k)
            k = k if k >= 0 else k + len(self)
            self._write(self._filler(value, k), k, k + 1)

    def _filler(self, value, start: int):
        if isinstance(value, (Array, list, np.ndarray)):
            v = value.series if isinstance(value, Array) else Series(np.asarray(value), self.dtype.name)
            return lambda s: v.astype(s.dtype)
        return lambda s: value

    def _write(self, value, start: int, stop: int | None) -> None:
        """Replace the elements from start to stop by value(series): a scalar, or a Series of as many elements."""
        if self._base is not None:
            stop = self._stop if stop is None else self._start + stop
            return self._base._write(value, self._start + start, stop)
        s = self._values
        v = value(s)
        if isinstance(v, Series):
            self._merge(v.df.select((F.col(POS) + start).alias(POS), v.column.alias("__v")))
            return None
        inside = (F.col(POS) >= start) & (F.col(POS) < stop) if stop is not None else F.col(POS) >= start
        self._values = s._new(F.when(inside, F.lit(v).cast(S.TYPES[s.dtype])).otherwise(s.column), s.dtype)
        return None

    def _merge(self, updates: DataFrame) -> None:
        """updates(position, __v) written over the values."""
        if self._base is not None:
            return self._base._merge(updates.withColumn(POS, F.col(POS) + self._start))
        s = self._values
        rows = s.df.select(POS, s.column.alias("__old")).join(updates.withColumn("__new", F.lit(True)), POS, "left")
        value = F.when(F.col("__new"), F.col("__v").cast(S.TYPES[s.dtype])).otherwise(F.col("__old"))
        self._values = s._new(F.col(s.name), s.dtype, rows.select(POS, value.alias(s.name)))
        return None

    def sum(self):
        return np.add.reduce(self)

    def prod(self):
        return np.multiply.reduce(self)

    def min(self):
        return np.minimum.reduce(self)

    def max(self):
        return np.maximum.reduce(self)

    def __repr__(self) -> str:
        return f"Array(dtype={self.series.dtype})"


def strided(data: DataFrame, start: int, shape: tuple[int, ...], strides: tuple[int, ...], end: int | None = None) -> DataFrame:
    """An n-dimensional walk over a vector data(POS, value): element i, in row-major order of `shape`, is the one at
    start + the sum of each coordinate times its stride. Strides may be 0, which repeats, or negative.

    The walk is computed from i by index arithmetic and joined by position; a position that data lacks fails the run.
    Elements from position `end` on are left out."""
    size = int(np.prod(shape, dtype=np.int64))
    i = F.col("__i")
    at, rest = F.lit(start).cast("bigint"), size
    for n, stride in zip(shape, strides, strict=True):
        rest //= max(n, 1)
        at = at + F.pmod(F.floor(i / rest), F.lit(n)) * stride
    walk = data.sparkSession.range(size).select(F.col("id").alias("__i")).withColumn(POS, at.cast("bigint"))
    if end is not None:
        walk = walk.where(F.col(POS) < end)
    got = walk.join(data.withColumn("__here", F.lit(True)), POS, "left")
    value = S.require(F.coalesce("__here", F.lit(False)), F.col("value"), "position out of range")
    return got.select(F.col("__i").alias(POS), value.alias("value"))

