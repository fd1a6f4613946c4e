"""Aggregates with the reference semantics: a sum of nothing is 0, nulls are skipped, lists are sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(c: Column | None = None, distinct: bool = False) -> Column:
    if c is None:
        return F.count(F.lit(1))
    return F.count_distinct(c) if distinct else F.count(c)


def sum_(c: Column, distinct: bool = False) -> Column:
    """Sum; 0 without values.  An integer overflow is an error, it doesn't saturate."""
    return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0))


def avg(c: Column) -> Column:
    return F.avg(c.cast("double"))


def collect(c: Column, by: Column | None = None, distinct: bool = False) -> Column:
    """Non-null values as a list, in the order of ``by`` (by default their own)."""
    if distinct:
        return F.array_sort(F.collect_set(c))
    if by is None:
        return F.array_sort(F.collect_list(c))
    pairs = F.filter(F.collect_list(F.struct(by.alias("k"), c.alias("v"))), lambda p: p["v"].isNotNull())
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def percentile_cont(c: Column, p: float) -> Column:
    """Linear interpolation between the neighbours."""
    return F.percentile(c, p)


def percentile_disc(column: str, p: float, kind: str) -> Column:
    """Nearest rank, in the type of the input."""
    return F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {column}) AS {kind})")


def stdev(c: Column) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def stdevp(c: Column) -> Column:
    return F.stddev_pop(c)
