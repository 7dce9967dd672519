"""Vectors inside a row (arrays) and dictionaries (maps)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import require

OPS = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "min": F.least, "max": F.greatest}


def map_(v: Column, f) -> Column:
    return F.transform(v, f)


def filter_(v: Column, p) -> Column:
    return F.filter(v, p)


def flatten(v: Column) -> Column:
    return F.flatten(v)


def length(v: Column) -> Column:
    return F.size(v).cast("bigint")


def lookup(v: Column, i: int | Column) -> Column:
    """Element i, from 0; out of range raises."""
    return v[i]


def slice_(v: Column, start: int, size: int) -> Column:
    """From 0; cut at the end."""
    return F.slice(v, start + 1, size)


def strided(v: Column, start: int, end: int, stride: int) -> Column:
    """Elements start, start + stride, ... of (end - start) // stride steps; a ragged last step is left out."""
    n = (end - start) // stride
    return F.array(*[v[start + k * stride] for k in range(n)])


def zip_(*vs: Column) -> Column:
    """Arrays of one length as an array of structs _0, _1, ...; other lengths raise."""
    same = reduce(lambda a, b: a & b, [F.size(vs[0]) == F.size(v) for v in vs[1:]], F.lit(True))
    names = [f"_{i}" for i in range(len(vs))]
    zipped = F.arrays_zip(*[v.alias(n) for v, n in zip(vs, names, strict=True)])
    return require(same, zipped, "zip of vectors of different lengths")


def reduce_(v: Column, op: str, start: Column) -> Column:
    return F.aggregate(v, start, OPS[op])


def scatter(base: Column, updates: Column, op: str) -> Column:
    """base with updates (array of structs i, v) merged in at their positions; those outside base are left out.

    Updates are sorted by position first, so a position with none costs one look-up and each update is read once."""
    order = F.array_sort(updates)
    at = F.transform(order, lambda u: u["i"])
    own = lambda i: F.slice(order, F.array_position(at, i).cast("int"), F.size(F.filter(at, lambda k: k == i)))
    merged = lambda x, i: F.aggregate(own(i), x, lambda a, u: OPS[op](a, u["v"]))
    return F.transform(base, lambda x, i: F.when(F.array_contains(at, i), merged(x, i)).otherwise(x))


def get_column(rows: Column, i: int) -> Column:
    """Field i of each struct of an array: a column of a matrix of rows."""
    return F.transform(rows, lambda r: get_field(r, i))


def get_field(value: Column, i: int) -> Column:
    """Field _i of a struct."""
    return value.getField(f"_{i}")


def sort(v: Column, key=None, descending: bool = False) -> Column:
    """By key, ties by the element itself."""
    if key is None:
        return F.sort_array(v, asc=not descending)
    pairs = F.sort_array(F.transform(v, lambda x: F.struct(key(x).alias("k"), x.alias("x"))), asc=not descending)
    return F.transform(pairs, lambda p: p["x"])


def sort_with(v: Column, comparator) -> Column:
    """By a comparator of two elements: below 0, 0 or above 0. Without one of your own: scalar.compare."""
    return F.array_sort(v, comparator)


def dot(v: Column, weights: list[float]) -> Column:
    """With a fixed vector: an unrolled sum, so it stays in generated code."""
    return reduce(lambda a, b: a + b, [v[i].cast("double") * F.lit(float(w)) for i, w in enumerate(weights)])


def dot_columns(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dict_lookup(d: Column, k: Column) -> Column:
    """A missing key raises."""
    return require(F.map_contains_key(d, k), F.element_at(d, k), "key not found")


def keyexists(d: Column, k) -> Column:
    return F.map_contains_key(d, k)


def optlookup(d: Column, k: Column, zero: Column) -> Column:
    """{found, value}; value is zero if the key is missing."""
    return F.struct(F.map_contains_key(d, k).alias("found"), F.coalesce(F.try_element_at(d, k), zero).alias("value"))


def tovec(d: Column) -> Column:
    return F.map_entries(d)


def range_(start: int, end: int, stride: int = 1) -> Column:
    n = (end - start) // stride
    return F.sequence(F.lit(start), F.lit(start + (n - 1) * stride), F.lit(stride)) if n else F.array().cast("array<int>")
