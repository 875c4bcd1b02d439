"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def finite(c: Column | str) -> Column:
    """The value where it is finite, else null: aggregates and windows then skip it."""
    return F.when(is_finite(c), col(c).cast("double"))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, else null."""
    out = None
    for holds, reason in cases:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out


def any_true(columns: Sequence[Column]) -> Column:
    """Whether one of the columns is true; null counts as false."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


def mapped(c: Column | str, values: dict, default=None) -> Column:
    """A value of a small fixed mapping."""
    out = None
    for k, v in values.items():
        out = F.when(col(c) == k, v) if out is None else out.when(col(c) == k, v)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def average_rank(value: str, *keys: str) -> Column:
    """One-based rank of value within keys, ties averaged; nulls must be filtered before."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))  # rows of an equal value, in the rank's own shuffle and sort
    return (F.rank().over(w) + (ties - 1) / F.lit(2.0)).cast("double")


def bucket(q: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    """floor(index * q / n) + 1 within keys, by order: not ntile, which places remainders elsewhere."""
    w = Window.partitionBy(*keys)
    index = F.row_number().over(w.orderBy(*order)).cast("long") - 1
    return F.floor(F.try_divide((index * q).cast("double"), F.count(F.lit(1)).over(w).cast("double"))).cast("int") + 1


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate: null where a side is constant, by an exact max = min test."""
    varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))
