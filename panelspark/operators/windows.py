"""Ordered windows over panels (W1-W18): minimum counts are always enforced, frames count rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.numeric import col, finite


def by(keys: Sequence[str] | str, order: str) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def _full(value: Column, w: WindowSpec, n: int, aggregate) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def rolling_sum(value: Column | str, w: WindowSpec, n: int) -> Column:
    """Sum of the last n rows; null unless all n are there and finite."""
    return _full(finite(value), w, n, F.sum)


def rolling_mean(value: Column | str, w: WindowSpec, n: int) -> Column:
    return _full(finite(value), w, n, F.avg)


def rolling_std(value: Column | str, w: WindowSpec, n: int) -> Column:
    return _full(finite(value), w, n, F.stddev_samp)


def rolling_max(value: Column | str, w: WindowSpec, n: int) -> Column:
    return _full(col(value), w, n, F.max)


def running_max(value: Column | str, w: WindowSpec) -> Column:
    return F.max(col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_sum(value: Column | str, w: WindowSpec) -> Column:
    """Sum of the finite values so far, carried over others; null before the first."""
    return F.sum(finite(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_growth(r: Column | str, w: WindowSpec) -> Column:
    """Product of 1 + r so far (W9), by logarithms; null from a return of -1 or less on."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.min(F.when(col(r) > -1, 1).otherwise(0)).over(frame) == 1
    return F.when(ok, F.exp(F.sum(F.when(col(r) > -1, F.log1p(col(r)))).over(frame)))


def running_product(factor: Column | str, w: WindowSpec) -> Column:
    """Product of the factors so far, nulls skipped (W9): magnitudes by logarithms, the sign by a count, 0 from a factor of 0 on."""
    x, frame = col(factor), w.rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.when(x == 0, 1).otherwise(0)).over(frame) == 1
    sign = F.when(F.count(F.when(x < 0, 1)).over(frame) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(lost, F.lit(0.0)).otherwise(sign * F.exp(F.sum(F.when(x != 0, F.ln(F.abs(x)))).over(frame)))


def with_rolling_fall(df: DataFrame, value: Column, w: WindowSpec, n: int, name: str) -> DataFrame:
    """df with the largest fall among the last n rows, each against the highest before it (W15, W18); 0 where there is none, null before n rows.

    A stretch is summed up as (top, bottom, worst), and two that follow each other combine: the later bottom against the earlier top.
    Stretches of 1, 2, 4, ... rows are made from two halves each, and n rows from the
    stretches of its binary digits, so a row holds a few numbers whatever n is, and all windows share one sort.
    """

    def combined(a: Column, b: Column) -> Column:
        across = F.when(a["top"] > 0, F.try_divide(b["bottom"], a["top"]) - 1)
        both = F.struct(F.greatest(a["top"], b["top"]).alias("top"), F.least(a["bottom"], b["bottom"]).alias("bottom"), F.least(a["worst"], b["worst"], across).alias("worst"))
        return F.when(a.isNotNull() & b.isNotNull(), both)

    one, have, made = F.struct(value.alias("top"), value.alias("bottom"), F.lit(0.0).alias("worst")), 0, False
    rows = df.withColumn("__part", one)
    for k in range(n.bit_length()):
        length = 1 << k
        if n & length:
            older = F.lag("__part", have).over(w) if have else F.col("__part")
            rows = rows.withColumn("__whole", combined(older, F.col("__whole")) if made else older)
            have, made = have + length, True
        if 2 * length <= n:
            rows = rows.withColumn("__part", combined(F.lag("__part", length).over(w), F.col("__part")))
    return rows.withColumn(name, F.col("__whole")["worst"]).drop("__part", "__whole")


def rolling_mean_of_valid(value: Column | str, w: WindowSpec, rows: int = 20, least: int = 10) -> Column:
    """Mean of the finite values among the last `rows` rows, if there are `least` of them."""
    v, frame = finite(value), w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(v).over(frame) >= least, F.avg(v).over(frame))


def weighted_sum(value: Column | str, w: WindowSpec, weights: Sequence[float]) -> Column:
    """Sum of weights[i] times the i-th of the last len(weights) rows, oldest first."""
    n, v = len(weights), finite(value)
    frame = w.rowsBetween(-(n - 1), 0)
    terms = F.zip_with(F.collect_list(v).over(frame), F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b)
    return F.when(F.count(v).over(frame) == n, F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def path_drawdown(log_return: Column | str, w: WindowSpec, n: int) -> Column:
    """Largest 1 - exp(path - running peak) of the path of the last n log returns, which starts at 0."""
    r = finite(log_return)
    frame = w.rowsBetween(-(n - 1), 0)
    start = F.struct(F.lit(0.0).alias("path"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, x: Column) -> Column:
        path = s["path"] + x
        peak = F.greatest(s["peak"], path)
        return F.struct(path.alias("path"), peak.alias("peak"), F.greatest(s["worst"], F.lit(1.0) - F.exp(path - peak)).alias("worst"))

    return F.when(F.count(r).over(frame) == n, F.aggregate(F.collect_list(r).over(frame), start, step, lambda s: s["worst"]))


def changed(flag: Column | str, w: WindowSpec) -> Column:
    """Whether a state differs from that of the row before; the first row does not."""
    before = F.lag(col(flag)).over(w)
    return F.coalesce(before.isNotNull() & (before != col(flag)), F.lit(False))


def island(flag: Column | str, w: WindowSpec) -> Column:
    """A number for each run of rows where flag is true: the count of other rows so far."""
    return F.sum(F.when(F.coalesce(col(flag), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
