"""User functions: scalar ones over vectors of values, functions of whole batches, and functions that give many rows.

All get Arrow or pandas batches; none is called for each row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_registered: dict[str, Callable[..., Column]] = {}


def register(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of pandas Series of one length, as a function of columns, also known by its name in SQL and to call()."""

    made = F.pandas_udf(_of_series(f), returns)
    spark.udf.register(name, made)
    _registered[name] = made
    return made


def _of_series(f: Callable[..., pd.Series]):
    import inspect

    n = len(inspect.signature(f).parameters)
    if n == 1:
        def one(a: pd.Series) -> pd.Series:
            return f(a)

        return one
    if n == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return f(a, b)

        return two

    def many(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    return many


def call(name: str, *columns: Column | str) -> Column:
    """A registered function applied to columns."""
    if name not in _registered:
        raise KeyError(f"no function {name!r} is registered")
    return _registered[name](*columns)


def over_batches(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A function of whole batches, which may return fewer or more rows than it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from f(pa.Table.from_batches([b])).to_batches()

    return df.mapInArrow(run, schema)


def expanding(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str):
    """A function that yields rows (tuples) for one row's values, as a table function for lateral joins and SQL."""

    class Expand:
        def eval(self, *values):
            yield from f(*values)

    made = F.udtf(Expand, returnType=returns)
    spark.udtf.register(name, made)
    return made


def load_library(spark: SparkSession, path: str) -> None:
    """Make a Python module or a zip of modules importable in user functions on every executor."""
    spark.sparkContext.addPyFile(path)


def lazy(f: Callable[..., Column]):
    """A function of Columns that also takes Series of one frame, and then gives a Series of the first one's type."""
    from ..operators.frame import Series

    @functools.wraps(f)
    def run(*args, **options):
        series = [a for a in args if isinstance(a, Series)]
        if not series:
            return f(*args, **options)
        first = series[0]
        if any(s.df is not first.df for s in series):
            raise ValueError("series of different frames")
        return first._new(f(*[a.column if isinstance(a, Series) else a for a in args], **options), first.dtype)

    return run
