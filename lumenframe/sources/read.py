"""Sources: in-memory data, delimited files, ranges and random columns. POS is the position of a row where one is needed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.semantics import TYPES

POS = "__pos"
#: Rows that one task may number, ranges that more rows are cut into, and the log of a block of positions.
ONE_TASK, RANGES, BLOCK = 1_000_000, 200, 20


def dtype_of(x) -> str:
    """The engine's type name of an array; strings are str. Mixed objects are refused."""
    a = np.asarray(x)
    if a.dtype.kind in "SU":
        return "str"
    if a.dtype == object:
        if all(isinstance(v, (str, bytes)) for v in a):
            return "str"
        raise TypeError("mixed objects are not supported")
    if a.dtype.name not in TYPES:
        raise TypeError(f"unsupported type {a.dtype}")
    return a.dtype.name


def values(x, name: str) -> pd.Series:
    a = np.asarray(x)
    if name == "str":
        return pd.Series([v.decode() if isinstance(v, bytes) else str(v) for v in a], dtype=object)
    if name == "uint64":
        import decimal

        return pd.Series([decimal.Decimal(int(v)) for v in a], dtype=object)
    wide = {"uint8": "int16", "uint16": "int32", "uint32": "int64"}.get(name, name)
    return pd.Series(a.astype(wide))


def from_columns(spark: SparkSession, data: dict[str, Sequence], dtypes: dict[str, str] | None = None, pos: bool = True) -> DataFrame:
    """A DataFrame of equally long columns, with their position."""
    kinds = {n: (dtypes or {}).get(n) or dtype_of(v) for n, v in data.items()}
    lengths = {len(v) for v in data.values()}
    if len(lengths) > 1:
        raise ValueError("columns of different lengths")
    pdf = pd.DataFrame({n: values(v, kinds[n]) for n, v in data.items()})
    schema = [T.StructField(n, TYPES[k]) for n, k in kinds.items()]
    if pos:
        pdf.insert(0, POS, np.arange(len(pdf), dtype=np.int64))
        schema.insert(0, T.StructField(POS, T.LongType()))
    # NaN is a value here, not a null
    columns = [pa.array(pdf[f.name].to_numpy(), to_arrow_type(f.dataType), from_pandas=False) for f in schema]
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in schema]), T.StructType(schema))


def matrix(spark: SparkSession, a: np.ndarray, name: str = "row") -> DataFrame:
    """A 2-D array as one array per row."""
    a = np.ascontiguousarray(a, np.float64)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
    return spark.createDataFrame(pa.table([pa.array(np.arange(len(a), dtype=np.int64)), rows], names=[POS, name]), f"{POS} long, {name} array<double>")


def with_position(df: DataFrame, *keys: str, descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """df with positions from 0 in the order of declared keys, and of ties within equal keys.

    Up to ONE_TASK rows, which are counted, one task numbers them. More are cut into ranges of the keys, at values drawn
    from a sample; each range is numbered by itself, from the number of rows in the ranges before."""
    way = lambda c: F.desc(c) if descending else F.asc(c)
    order = [*map(way, keys), *map(F.asc, ties)]
    rows = df.limit(ONE_TASK + 1).count()
    if rows <= ONE_TASK:
        return df.withColumn(POS, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    rows = df.count()
    drawn = df.select(*keys).sample(min(1.0, RANGES * 100 / rows), 11).orderBy(*map(way, keys)).collect()
    cuts = [drawn[i] for i in range(len(drawn) // RANGES, len(drawn), max(1, len(drawn) // RANGES))]
    key = F.struct(*[F.col(k) for k in keys])
    kinds = [df.schema[k].dataType for k in keys]
    before = [key > F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, c, kinds, strict=True)]) for c in cuts]
    before = [~b for b in before] if descending else before
    return numbered(df.withColumn("__range", sum((b.cast("int") for b in before), F.lit(0))), order)


def renumbered(df: DataFrame) -> DataFrame:
    """Rows that have positions, which may have gaps, at positions from 0 in the same order. Blocks of positions are
    numbered by themselves, from the number of rows in the blocks before."""
    return numbered(df.withColumn("__range", F.shiftright(F.col(POS), BLOCK)), [F.col(POS)])


def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Positions of rows whose column __range is the first part of their order."""
    sizes = df.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    first = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    sizes = sizes.select("__range", first.alias("__first"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("bigint") - 1
    out = df.withColumn("__own", own).join(sizes, "__range")
    return out.withColumn(POS, F.col("__own") + F.col("__first")).drop("__own", "__first", "__range")


def parquet(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, na_values: Sequence[str] = (), drop_na: bool = False) -> DataFrame:
    """A delimited file with a declared schema; na_values read as null in every column."""
    fields = T._parse_datatype_string(schema)
    df = spark.read.option("sep", sep).option("header", header).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).csv(path)
    na = list(na_values)
    null = lambda c: F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c)) if na else F.col(c)
    df = df.select(*[null(f.name).cast(f.dataType).alias(f.name) for f in fields])
    return df.na.drop() if drop_na else df


def csv_by_file(spark: SparkSession, glob: str, schema: str, column: str, pattern: str, sep: str = ",") -> DataFrame:
    """Many files as one, with a column taken from each file's name by a pattern's first group."""
    return spark.read.option("sep", sep).schema(schema).csv(glob).withColumn(column, F.regexp_extract(F.input_file_name(), pattern, 1))


def range_iter(spark: SparkSession, start: int, end: int, stride: int = 1) -> DataFrame:
    """(end - start) // stride values from start; a ragged last step is left out."""
    n = (end - start) // stride
    return spark.range(n).select(F.col("id").alias(POS), (F.lit(start) + F.col("id") * stride).alias("value"))


def random(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(POS), F.rand(seed).alias("value"))
