"""String functions with byte-string (ASCII) case rules, literal patterns and Python-like positions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def lower(s: Column) -> Column:
    """A-Z only."""
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def upper(s: Column) -> Column:
    """a-z only."""
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def capitalize(s: Column) -> Column:
    return F.concat(upper(F.substring(s, 1, 1)), lower(F.substring(s, F.lit(2), F.length(s))))


def get(s: Column, i: int) -> Column:
    """The character at i, from the end if negative; empty if there is none."""
    n = F.length(s)
    return F.when((n <= i) | (n < -i), F.lit("")).otherwise(F.substring(s, i + 1 if i >= 0 else i, 1))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE))


def contains(s: Column, pattern: str) -> Column:
    return F.contains(s, F.lit(pattern))


def startswith(s: Column, pattern: str) -> Column:
    return F.startswith(s, F.lit(pattern))


def endswith(s: Column, pattern: str) -> Column:
    return F.endswith(s, F.lit(pattern))


def find(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """First position of sub within [start, end), else -1; a negative start finds nothing."""
    if start < 0:
        return F.lit(-1).cast("bigint")
    stop = F.length(s) if end is None else F.least(F.lit(end), F.length(s))
    at = F.locate(sub, F.substring(s, F.lit(start + 1), F.greatest(stop - start, F.lit(0))))
    return F.when(at == 0, F.lit(-1)).otherwise(at - 1 + start).cast("bigint")


def replace(s: Column, pattern: str, by: str) -> Column:
    """The first occurrence only."""
    at = F.instr(s, pattern)
    return F.when(at > 0, F.overlay(s, F.lit(by), at, F.lit(len(pattern)))).otherwise(s)


def slice_(s: Column, start: int, size: int) -> Column:
    return F.substring(s, start + 1, size)
