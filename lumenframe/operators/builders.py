"""Builders: reductions, keyed reductions, grouping and scatter-reduction as aggregations.

Each builder has add(df) for a batch of rows and result(). Batches are merged by aggregating partial states again, so a
builder can be resumed, stored between runs and fed from a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.semantics import TYPES, identity
from ..sources.read import POS
from . import relational as R

REDUCE = {"+": F.sum, "*": F.product, "min": F.min, "max": F.max}
COMBINE = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "min": F.least, "max": F.greatest}


def reduced(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Reductions of columns by keys; products of integers are exact modulo 2**64."""
    exact = {n: c for n, (op, c) in aggs.items() if op == "*" and R.integral(df, c)}
    rest = [REDUCE[op](c).alias(n) for n, (op, c) in aggs.items() if n not in exact]
    if not exact:
        return df.groupBy(*keys).agg(*rest)
    out = R.exact_products(df, keys, exact)
    if rest:
        others = df.groupBy(*keys).agg(*rest)
        if keys:
            same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
            out = out.alias("x").join(others.alias("y"), same).select("x.*", *[F.col(f"y.{n}") for n in aggs if n not in exact])
        else:  # one row each
            for n in aggs:
                if n not in exact:
                    out = out.withColumn(n, others.select(n).scalar())
    return out.select(*keys, *aggs)


class _Builder:
    def __init__(self):
        self.state: DataFrame | None = None

    def store(self, path: str) -> _Builder:
        """Write the state, from which a builder of the same kind goes on in another run by resume(path)."""
        self.state.write.mode("overwrite").parquet(path)
        return self

    def resume(self, spark, path: str) -> _Builder:
        stored = spark.read.parquet(path)
        self.state = stored if self.state is None else self._partial_again(self.state.unionByName(stored))
        return self

    def add(self, df: DataFrame) -> _Builder:
        part = self._partial(df)
        self.state = part if self.state is None else self._partial_again(self.state.unionByName(part))
        return self


class Appender(_Builder):
    """Rows in the order of position; result() is the rows, vector() one array."""

    def __init__(self, value: Column | str):
        super().__init__()
        self.value, self.batches = value, 0

    def _partial(self, df: DataFrame) -> DataFrame:
        value = F.col(self.value) if isinstance(self.value, str) else self.value
        self.batches += 1
        return df.select(F.lit(self.batches).alias("batch"), POS, value.alias("value"))

    def _partial_again(self, df: DataFrame) -> DataFrame:
        return df

    def result(self) -> DataFrame:
        return self.state

    def vector(self) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("batch", POS, "value")))
        return self.state.agg(F.transform(rows, lambda r: r["value"]).alias("value"))


class Merger(_Builder):
    """Reductions of a batch: aggs maps an output name to (op, column, type); empty input yields the identity. Integers
    wrap in their type."""

    def __init__(self, aggs: dict[str, tuple[str, str, str]], start: dict[str, object] | None = None):
        super().__init__()
        self.aggs, self.start = aggs, start or {}

    def _partial(self, df: DataFrame) -> DataFrame:
        # sums of integers are kept wide until the result wraps
        wide = {n: (op, f"__{n}") for n, (op, _, _) in self.aggs.items()}
        cols = [(F.col(c).cast("decimal(38,0)") if op == "+" and not S.is_float(k) else F.col(c)).alias(f"__{n}") for n, (op, c, k) in self.aggs.items()]
        return reduced(df.select(*cols), [], wide)

    def _partial_again(self, df: DataFrame) -> DataFrame:
        return reduced(df, [], {n: (op, n) for n, (op, _, _) in self.aggs.items()})

    def result(self) -> DataFrame:
        out = []
        for n, (op, _, kind) in self.aggs.items():
            c = F.coalesce(F.col(n), F.lit(identity(op, kind)))
            if S.is_float(kind):
                c = COMBINE[op](c, F.lit(self.start[n])) if n in self.start else c
            elif op == "*":
                c = S.wrap_mul(c, F.lit(self.start.get(n, 1)), kind)
            else:
                c = c.cast("decimal(38,0)")
                c = S.wrap(COMBINE[op](c, F.lit(self.start[n]).cast("decimal(38,0)")) if n in self.start else c, kind)
            out.append(c.cast(TYPES[kind]).alias(n))
        return self.state.select(*out)


class DictMerger(_Builder):
    """Reductions by key: a hash aggregation with map-side partial states."""

    def __init__(self, keys: list[str], aggs: dict[str, tuple[str, str]]):
        super().__init__()
        self.keys, self.aggs = keys, aggs

    def _partial(self, df: DataFrame) -> DataFrame:
        return reduced(df, self.keys, self.aggs)

    def _partial_again(self, df: DataFrame) -> DataFrame:
        return reduced(df, self.keys, {n: (op, n) for n, (op, _) in self.aggs.items()})

    def result(self) -> DataFrame:
        return self.state

    def dictionary(self) -> DataFrame:
        """One row with a map from key struct to value struct; for small results."""
        entry = F.struct(F.struct(*self.keys).alias("key"), F.struct(*self.aggs).alias("value"))
        return self.state.agg(F.map_from_entries(F.collect_list(entry)).alias("dict"))


class GroupMerger(_Builder):
    """Values by key in the order of `order`. A group is gathered into one row: use windows for large groups."""

    def __init__(self, keys: list[str], value: str, order: list[str]):
        super().__init__()
        self.keys, self.value, self.order = keys, value, order

    def _partial(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, F.struct(*self.order).alias("o"), F.col(self.value).alias("v"))

    def _partial_again(self, df: DataFrame) -> DataFrame:
        return df

    def result(self) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("o", "v")))
        return self.state.groupBy(*self.keys).agg(F.transform(rows, lambda r: r["v"]).alias(self.value))


class VecMerger(_Builder):
    """Scatter-reduction into a copy of a base vector: base(pos, value) and updates(pos, value). Updates at positions that
    the base does not have are left out."""

    def __init__(self, base: DataFrame, op: str, pos: str = POS, value: str = "value"):
        super().__init__()
        self.op, self.pos, self.value = op, pos, value
        self.base = base.select(pos, value)

    def _partial(self, df: DataFrame) -> DataFrame:
        return reduced(df, [self.pos], {self.value: (self.op, self.value)})

    def _partial_again(self, df: DataFrame) -> DataFrame:
        return self._partial(df)

    def result(self) -> DataFrame:
        if self.state is None:
            return self.base
        # one pass over both: a group without a row of the base goes
        both = self.base.withColumn("__base", F.lit(True)).unionByName(self.state.withColumn("__base", F.lit(None).cast("boolean")))
        if self.op == "*" and R.integral(self.base, self.value):
            return self._partial(both.drop("__base")).join(self.base.select(self.pos), self.pos, "left_semi")
        out = both.groupBy(self.pos).agg(REDUCE[self.op](self.value).cast(self.base.schema[self.value].dataType).alias(self.value), F.max("__base").alias("__base"))
        return out.where("__base").drop("__base")


def iterate_rows(df: DataFrame, step, done, save, most: int = 100) -> DataFrame:
    """A DataFrame state stepped until done(state); it steps at least once. save(df) cuts the lineage of each state."""
    for _ in range(most):
        df = save(step(df))
        if done(df):
            return df
    raise RuntimeError("iterate: no end")
