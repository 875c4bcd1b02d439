"""Exact percentiles of groups too large for one task (A11, A13), by narrowing down.

Each target (a rank within a key) has an interval that its value lies in. A pass takes approximate quantiles of what is in the
interval, which are values that are really there, as cuts on both sides of the rank, and counts exactly what lies before, at, between, at
and after the two cuts, with the smallest and largest value of each: the part that holds the rank is the next interval. The approximation
only decides how fast it goes, about 5 / GRID of the rows being left each time, whatever their distribution; a cut itself is one value, so ties end. What is left in few rows
(SMALL at most) is sorted. Sketches and counts are added up within tasks first, so little travels.

Defined results: nulls and non-finite values are left out; a key without values has null percentiles; ranks between two
values are interpolated linearly; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import finite
from panelspark.operators.relational import chain_keys, cut_lineage, small

GRID, SMALL = 256, 10_000


def _same(left: list[str], right: list[str]) -> Column:
    return chain_keys([F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], few: int = SMALL, grid: int = GRID) -> DataFrame:
    """keys and a column for each of points (name to share from 0 to 1)."""
    ks = [f"__k{i}" for i in range(len(keys))]
    every = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)])
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], finite(value).cast("double").alias("v")).where("v is not null")
    ends = rows.groupBy(*ks).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
    at = F.array(*[(F.col("n") - 1) * F.lit(float(p)) for p in points.values()])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    targets = cut_lineage(ends.select(*ks, "n", "a", "b", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank")))
    sizes = targets.select(*ks, F.col("n").alias("whole")).distinct()

    spans_of = lambda t, *more: t.select(*[F.col(k).alias(f"s{k}") for k in ks], F.col("a").alias("sa"), F.col("b").alias("sb"), *more).distinct()
    sks, inside = [f"s{k}" for k in ks], F.col("v").between(F.col("sa"), F.col("sb"))

    def pass_(open_: DataFrame) -> DataFrame:
        """The targets' next intervals."""
        shares = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
        cuts = rows.join(small(spans_of(open_)), _same(ks, sks) & inside).groupBy(*sks, "sa", "sb").agg(F.percentile_approx("v", shares, 4 * grid).alias("cuts"))
        i = F.floor((F.col("rank") - F.col("below")) / (F.col("n") - 1) * grid).cast("int")
        cut = open_.join(cuts, _same([*ks, "a", "b"], [*sks, "sa", "sb"])).select(*open_.columns, F.get("cuts", F.greatest(i - 2, F.lit(0))).alias("low"), F.get("cuts", F.least(i + 3, F.lit(grid))).alias("high"))
        cut = cut_lineage(cut)
        sides = small(spans_of(cut, F.col("low").alias("sl"), F.col("high").alias("sh")))
        part = F.when(F.col("v") < F.col("sl"), 0).when(F.col("v") == F.col("sl"), 1).when(F.col("v") < F.col("sh"), 2).when(F.col("v") == F.col("sh"), 3).otherwise(4)
        each = [*sks, "sa", "sb", "sl", "sh"]
        counts = rows.join(sides, _same(ks, sks) & inside).groupBy(*each, part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*each).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # five rows
        counts = counts.withColumn("before", before)
        on = _same([*ks, "a", "b", "low", "high"], each) & (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("m"))
        return cut.join(counts, on).select(*ks, F.col("m").alias("n"), F.col("least").alias("a"), F.col("most").alias("b"), (F.col("below") + F.col("before")).alias("below"), "rank")

    done = targets.where("a = b")
    open_ = targets.where(f"a < b and n > {few}")
    rest = targets.where(f"a < b and n <= {few}")
    while not open_.isEmpty():
        targets = cut_lineage(pass_(open_))
        done, rest = done.unionByName(targets.where("a = b")), rest.unionByName(targets.where(f"a < b and n <= {few}"))
        open_ = targets.where(f"a < b and n > {few}")
    held = rows.join(small(spans_of(rest)), _same(ks, sks) & inside).groupBy(*sks, "sa", "sb").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # few rows at most
    sorted_ = rest.join(held, _same([*ks, "a", "b"], [*sks, "sa", "sb"])).select(*ks, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    values = done.select(*ks, "rank", F.col("a").alias("v")).unionByName(sorted_)
    by_rank = values.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by"))  # two ranks a point

    def point(p: float) -> Column:
        x = (F.col("whole") - 1) * F.lit(float(p))
        low, high = F.try_element_at("by", F.floor(x)), F.try_element_at("by", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    named = by_rank.select(*[F.col(k).alias(f"r{k}") for k in ks], "by")
    found = sizes.join(named, _same(ks, [f"r{k}" for k in ks])).select(*[F.col(k).alias(f"f{k}") for k in ks], *[point(p).alias(n) for n, p in points.items()])
    out = every.distinct().join(found, _same(ks, [f"f{k}" for k in ks]), "left")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, ks)], *points)
