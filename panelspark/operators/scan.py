"""Carrying a state along one very long history (J6, J7, W8-W10): ranges of time, each in a task of its own, and a prefix over their ends.

A window over a key is one task for that key. Here the time axis is cut into ranges of about as many rows each, found
from a histogram of CELLS equal cells (one row a cell, which bounds what is collected and broadcast). Windows run within
(key, range); one row for each says what it ends with; a second window over
those rows gives each range what the ranges before it left, and the two are combined. That is right for any
associative step: the last value seen, sums, counts, largest and smallest values. Rows of one instant stay together, so a
range can be larger than asked for only where a cell is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.relational import chain_keys

CELLS = 1 << 16
#: Rows of a range.
ROWS = 2_000_000


def _axis(df: DataFrame, on: str) -> Column:
    """The order of `on` as a number."""
    kind = dict(df.dtypes)[on]
    return F.unix_micros(F.col(on).cast("timestamp")).cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(on).cast("double")


def with_ranges(df: DataFrame, on: str, rows: int = ROWS, name: str = "__range") -> DataFrame:
    """df with the number of the range of time that `on` is in; rows without a time are in range 0."""
    t = _axis(df, on)
    low, high = df.agg(F.min(t), F.max(t)).first()
    if low is None or low == high:
        return df.withColumn(name, F.lit(0).cast("long"))
    cell = F.floor((t - F.lit(low)) / F.lit(high - low) * (CELLS - 1))
    counts = df.groupBy(cell.alias("__cell")).count()
    before = F.sum("count").over(Window.orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))  # CELLS rows at most
    cut = counts.select("__cell", F.floor(F.coalesce(before, F.lit(0)) / rows).alias(name)).where("__cell is not null")
    return df.withColumn("__cell", cell).join(F.broadcast(cut), "__cell", "left").drop("__cell").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def met(rows: DataFrame, ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with what the ranges before theirs left; ends: one row for each key and range."""
    names = [*by, "__range"]
    named = ends.select(*[F.col(k).alias(f"__at_{i}") for i, k in enumerate(names)], *[c for c in ends.columns if c not in names])
    on = chain_keys([F.col(k).eqNullSafe(F.col(f"__at_{i}")) for i, k in enumerate(names)])
    return rows.join(named, on, "left").drop(*[f"__at_{i}" for i in range(len(names))])


def running(df: DataFrame, by: Sequence[str], on: str, order: Sequence[str], sums: dict[str, Column], tops: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """df with running sums and largest values of each key in the order of (on, *order), nulls skipped; by may be empty."""
    dealt = with_ranges(df.withColumns({f"__v_{n}": v for n, v in (sums | tops).items()}), on, rows)
    inside = Window.partitionBy(*by, "__range").orderBy(on, *order).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {n: F.sum for n in sums} | {n: F.max for n in tops}
    ends = dealt.groupBy(*by, "__range").agg(*[f(f"__v_{n}").alias(f"__e_{n}") for n, f in kinds.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__range", *[f(f"__e_{n}").over(earlier).alias(f"__c_{n}") for n, f in kinds.items()])
    own = dealt.withColumns({f"__o_{n}": f(f"__v_{n}").over(inside) for n, f in kinds.items()})
    both = lambda n: F.coalesce(F.col(f"__o_{n}") + F.col(f"__c_{n}"), F.col(f"__o_{n}"), F.col(f"__c_{n}")) if n in sums else F.greatest(F.col(f"__o_{n}"), F.col(f"__c_{n}"))
    return met(own, ends, by).select(*df.columns, *[both(n).alias(n) for n in kinds])


def asof_backward_ranges(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = False, rows: int = ROWS) -> DataFrame:
    """What `relational.asof_backward` gives, for keys whose history is longer than a task should hold."""
    payload = F.struct(F.col(on).alias("matched"), *[F.col(v) for v in values])
    l_order, r_order = (0, 1) if strict else (1, 0)
    keys = [f"__k_{i}" for i in range(len(by))]
    named = lambda df: [F.col(k).alias(n) for k, n in zip(by, keys)]
    a = left.select(F.struct(*left.columns).alias("__left"), *named(left), F.col(on).alias("__on"), F.lit(l_order).alias("__side"))
    b = right.where(F.col(on).isNotNull()).select(*named(right), F.col(on).alias("__on"), F.lit(r_order).alias("__side"), payload.alias("__right"))
    both = with_ranges(a.unionByName(b, allowMissingColumns=True), "__on", rows)
    inside = Window.partitionBy(*keys, "__range").orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.where("__right is not null").groupBy(*keys, "__range").agg(F.max_by("__right", "__on").alias("__end"))
    # a range that has left rows only passes on what came before it
    ends = ends.unionByName(both.select(*keys, "__range").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))).groupBy(*keys, "__range").agg(F.first("__end", ignorenulls=True).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__range", F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    own = both.withColumn("__own", F.last("__right", ignorenulls=True).over(inside)).where("__left is not null").drop("__right")
    known = chain_keys([F.col("__on").isNotNull(), *[F.col(k).isNotNull() for k in keys]])
    found = F.when(known, F.coalesce("__own", "__carry"))
    return met(own, ends, keys).select("__left.*", found["matched"].alias(f"{on}_matched"), *[found[v].alias(v) for v in values])
