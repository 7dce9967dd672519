"""Joins, grouping, pivots, top-n and sorting on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S
from ..functions.semantics import NAN, require

#: One row has no sample variance or deviation: NaN. `prod` is for floats; integers go through exact_products.
AGGS = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg, "var": lambda c: S.sample_moment(F.var_samp(c)), "std": lambda c: S.sample_moment(F.stddev_samp(c)), "count": lambda c: F.count(F.lit(1))}
#: Rows of a side that a nested loop may send to every task.
NESTED = 1_000_000


def integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def exact_products(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """keys and, by output name, the products of integer columns modulo 2**64, as 64-bit integers; nulls are left out.

    Spark's own product is a double. Each batch of rows gives one partial product per key, by NumPy; the partials of a
    key, no more than batches, are folded exactly. Without keys there is one row, of ones if there are no rows."""
    names = list(columns)
    rows = df.select(*keys, *[F.col(c).cast("bigint").alias(n) for n, c in columns.items()])
    fields = [rows.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in names]

    def partial(batches):
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b])
            products = lambda t: [[int(x.to_numpy(zero_copy_only=False).prod(dtype="int64"))] for x in (t.column(n).combine_chunks().drop_null() for n in names)]
            if not keys:
                yield from pa.table(dict(zip(names, products(t), strict=True)), schema=pa.schema([(n, pa.int64()) for n in names])).to_batches()
                continue
            at = t.select(list(keys)).append_column("__at", pa.array(range(t.num_rows)))
            groups = at.group_by(list(keys)).aggregate([("__at", "list")])
            found = [products(t.take(i.values)) for i in groups.column("__at_list").combine_chunks()] if t.num_rows else []
            out = [groups.column(k) for k in keys] + [pa.array([f[j][0] for f in found], pa.int64()) for j in range(len(names))]
            yield from pa.table(out, names=[*keys, *names]).to_batches()

    fold = lambda n: F.aggregate(F.collect_list(n), F.lit(1).cast("bigint"), lambda a, x: S.wrap_mul(a, x, "int64")).alias(n)
    return rows.mapInArrow(partial, T.StructType(fields)).groupBy(*keys).agg(*[fold(n) for n in names])


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def merge(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Natural inner join on all shared column names: keys, the rest of left, the rest of right. strict: a left row
    without a match fails the run."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no shared columns")
    rest = [c for c in right.columns if c not in keys]
    if strict:
        found = right.withColumn("__found", F.lit(True))
        joined = left.join(found, keys, "left")
        joined = joined.withColumn(keys[0], require(F.coalesce("__found", F.lit(False)), F.col(keys[0]), "unmatched key"))
    else:
        joined = left.join(right, keys)
    return joined.select(*keys, *[c for c in left.columns if c not in keys], *rest)


def semi(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None) -> DataFrame:
    return left.join(right.select(F.col(right_on or on).alias(on)), on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None) -> DataFrame:
    return left.join(right.select(F.col(right_on or on).alias(on)), on, "left_anti")


def isin(left: DataFrame, column: str, right: DataFrame, right_column: str, out: str) -> DataFrame:
    """left with a boolean column: whether the value is found on the right. Both sides must be of one type."""
    if left.schema[column].dataType != right.schema[right_column].dataType:
        raise TypeError("isin of different types")
    keys = right.select(F.col(right_column).alias("__k"), F.lit(True).alias("__in")).distinct()
    joined = left.join(keys, left[column] == F.col("__k"), "left").drop("__k")
    return joined.withColumn(out, F.coalesce("__in", F.lit(False))).drop("__in")


def optlookup(left: DataFrame, right: DataFrame, on: str, value: str, zero, out: str) -> DataFrame:
    """left with {found, value} of the right side's row of the same key; zero if there is none."""
    side = right.select(on, F.col(value).alias("__v"), F.lit(True).alias("__f"))
    found = F.struct(F.coalesce("__f", F.lit(False)).alias("found"), F.coalesce("__v", F.lit(zero)).alias("value"))
    return left.join(side, on, "left").withColumn(out, found).drop("__v", "__f")


def theta(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs that meet a condition which is no equality. Spark runs it as a nested loop that sends one side to every
    task, so one side must have NESTED rows at most; else this raises."""
    if right.limit(NESTED + 1).count() <= NESTED:
        return left.join(F.broadcast(right), condition)
    if left.limit(NESTED + 1).count() <= NESTED:
        return F.broadcast(left).join(right, condition)
    raise ValueError(f"no side has {NESTED} rows or less")


def zip_join(left: DataFrame, right: DataFrame, pos: str = "__pos") -> DataFrame:
    """Columns of two frames side by side, by position; a position that only one of them has fails the run."""
    both = left.withColumn("__left", F.lit(True)).join(right.withColumn("__right", F.lit(True)), pos, "full_outer")
    here = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    return both.where(require(here, F.lit(True), "zip of columns of different lengths")).drop("__left", "__right")


def fill_by_total(df: DataFrame, column: str, out: str, agg: str = "sum") -> DataFrame:
    """df with each value's share of a total over all rows, which is a scalar subquery."""
    return df.withColumn(out, F.col(column) / df.agg(AGGS[agg](column).alias("total")).scalar())


class GroupBy:
    """Groups of a DataFrame by keys; each method is one lazy aggregation."""

    def __init__(self, df: DataFrame, keys, values=None):
        self.df, self.keys = df, _list(keys)
        self.values = _list(values) if values is not None else [c for c in df.columns if c not in self.keys]

    def __getitem__(self, values) -> GroupBy:
        return GroupBy(self.df, self.keys, values)

    def agg(self, how: str) -> DataFrame:
        if how == "prod" and (whole := [v for v in self.values if integral(self.df, v)]):
            out = exact_products(self.df, self.keys, {v: v for v in whole})
            if rest := [v for v in self.values if v not in whole]:
                out = out.join(GroupBy(self.df, self.keys, rest).agg(how), self.keys)
            return out.select(*self.keys, *self.values)
        return self.df.groupBy(*self.keys).agg(*[AGGS[how](v).alias(v) for v in self.values])

    def prod(self) -> DataFrame:
        return self.agg("prod")

    def sum(self) -> DataFrame:
        return self.agg("sum")

    def mean(self) -> DataFrame:
        return self.agg("mean")

    def min(self) -> DataFrame:
        return self.agg("min")

    def max(self) -> DataFrame:
        return self.agg("max")

    def std(self) -> DataFrame:
        return self.agg("std")

    def var(self) -> DataFrame:
        return self.agg("var")

    def count(self) -> DataFrame:
        return self.agg("count")

    def size(self, out: str = "size") -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(out)).orderBy(*self.keys)

    def apply(self, f):
        """f gets the grouping as a whole."""
        return f(self)

    def apply_in_pandas(self, f, schema: str) -> DataFrame:
        return self.df.groupBy(*self.keys).applyInPandas(f, schema)

    def sort_values(self, by, ascending: bool = True, ties: Sequence[str] = ()) -> SortedGroups:
        return SortedGroups(self, _list(by), ascending, list(ties))


class SortedGroups:
    """Rows sorted within their groups: a window, never a gathered list."""

    def __init__(self, groups: GroupBy, by: list[str], ascending: bool, ties: list[str], start: int = 0, stop: int | None = None):
        self.groups, self.by, self.ascending, self.ties, self.start, self.stop = groups, by, ascending, ties, start, stop

    def slice(self, start: int, size: int) -> SortedGroups:
        return SortedGroups(self.groups, self.by, self.ascending, self.ties, self.start + start, self.start + start + size)

    def reset_index(self, rank: str | None = None) -> DataFrame:
        order = [F.col(c).asc() if self.ascending else F.col(c).desc() for c in self.by] + [F.col(c).asc() for c in self.ties]
        df = self.groups.df.withColumn("__rn", F.row_number().over(Window.partitionBy(*self.groups.keys).orderBy(*order)))
        df = df.where(F.col("__rn") > self.start)
        if self.stop is not None:
            df = df.where(F.col("__rn") <= self.stop)
        return df.withColumnRenamed("__rn", rank) if rank else df.drop("__rn")


class Pivot:
    """A wide table: the index column and one column per pivoted value. Missing cells are null."""

    def __init__(self, df: DataFrame, index: str, columns: list[str]):
        self.df, self.index, self.columns = df, index, columns

    def __getitem__(self, column: str) -> Column:
        return F.col(column)

    def with_column(self, name: str, value: Column) -> Pivot:
        return Pivot(self.df.withColumn(name, value), self.index, [*[c for c in self.columns if c != name], name])

    def total(self) -> Column:
        """The sum of each row (axis 1)."""
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in self.columns])

    def div(self, by: Column) -> Pivot:
        """Each row divided by its value of `by` (axis 0)."""
        return Pivot(self.df.select(self.index, *[(F.col(c) / by).alias(c) for c in self.columns]), self.index, self.columns)

    def loc(self, keys: DataFrame, column: str | None = None) -> Pivot:
        return Pivot(semi(self.df, keys, self.index, column or self.index), self.index, self.columns)

    def sort_values(self, by: str, ascending: bool = True) -> DataFrame:
        return self.df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), self.index)


def pivot_table(df: DataFrame, values: str, index: str, columns: str, names: Sequence, aggfunc: str = "sum") -> Pivot:
    """names lists the values of `columns`, so the plan needs no extra pass to find them."""
    wide = df.groupBy(index).pivot(columns, list(names)).agg(AGGS[aggfunc](F.col(values).cast("double")))
    return Pivot(wide, index, [str(n) for n in names])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def slice_rows(df: DataFrame, start: int, stop: int, pos: str = "__pos") -> DataFrame:
    return df.where((F.col(pos) >= start) & (F.col(pos) < stop))


def strided_rows(df: DataFrame, start: int, end: int, stride: int, pos: str = "__pos") -> DataFrame:
    """Rows start, start + stride, ..., (end - start) // stride of them."""
    last = start + (end - start) // stride * stride
    return df.where((F.col(pos) >= start) & (F.col(pos) < last) & ((F.col(pos) - start) % stride == 0))


def summary(df: DataFrame, column: str, aggs: Sequence[str], floating: bool, kind: str | None = None) -> DataFrame:
    """agg, value for a list of aggregates, computed in one pass. All are doubles if any is a mean, variance or
    deviation, or the column floats; else 64-bit integers. One row has no deviation: NaN.

    kind: the column's type in the engine's own API. Then integer sums wrap, integer products are exact modulo 2**64, and
    no rows give the identities: 0, 1, the type's largest value for min and its smallest for max."""
    dbl = floating or any(a in ("mean", "var", "std") for a in aggs)
    to = "double" if dbl else "bigint"

    def value(a: str) -> Column:
        if a in ("var", "std"):
            return F.coalesce(AGGS[a](column), F.lit(NAN))
        if kind is None or a in ("mean", "count"):
            return AGGS[a](column)
        op = {"sum": "+", "prod": "*"}.get(a, a)
        if a == "sum" and not floating:
            return S.wrap(F.coalesce(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(0)), "int64")
        return S.or_identity(AGGS[a](column), op, kind if a in ("min", "max") else "float64" if floating else "int64")

    exact = [a for a in dict.fromkeys(aggs) if a == "prod" and not floating]
    one = df.agg(*[value(a).cast(to).alias(a) for a in dict.fromkeys(aggs) if a not in exact] or [F.lit(0).alias("__none")])
    if exact:
        one = one.withColumn("prod", exact_products(df, [], {"prod": column}).scalar().cast(to))
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(a).alias("agg"), F.col(a).alias("value")) for a in aggs])).alias("i", "x")).select("i", "x.agg", "x.value")
