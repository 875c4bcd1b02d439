"""Inference on study series: HAC means, normal p-values, multiple testing."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelspark.functions.numeric import finite, first_reason, is_finite
from panelspark.operators.scan import ROWS, met, with_ranges


@F.pandas_udf(DoubleType())
def normal_p_value(t: pd.Series) -> pd.Series:
    """Two-sided p-value erfc(|t| / sqrt 2): Spark has no erfc. Small summary tables only come here."""
    return t.map(lambda x: None if pd.isna(x) else erfc(abs(x) / sqrt(2.0)))


def hac_sums(series: DataFrame, value: str, keys: Sequence[str], order: str, horizon: int) -> DataFrame:
    """Count, mean, lag and Bartlett-weighted long-run variance of each key's series.

    The lag is min(horizon - 1, sessions - 1) and pairs are positional on the whole axis:
    an invalid row leaves a gap, it does not bring its neighbours together.
    """
    w = Window.partitionBy(*keys)
    axis = w.orderBy(order)
    rows = series.withColumn("__v", finite(value))
    rows = rows.withColumns({"__n": F.count("__v").over(w), "__e": F.col("__v") - F.avg("__v").over(w)})
    products = {f"__g{k}": F.col("__e") * F.lag("__e", k).over(axis) for k in range(horizon)}
    rows = rows.withColumns(products)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("__sessions"), F.count("__v").alias("n_valid"), F.avg("__v").alias("mean"), *[F.coalesce(F.sum(g), F.lit(0.0)).alias(g) for g in products])
    lag = F.greatest(F.least(F.lit(horizon - 1), F.col("__sessions") - 1), F.lit(0)).cast("int")
    total: Column = F.col("__g0")
    for k in range(1, horizon):
        total = total + F.when(k <= F.col("lag"), (F.lit(1.0) - F.lit(float(k)) / (F.col("lag") + 1)) * 2 * F.col(f"__g{k}")).otherwise(0.0)
    out = sums.withColumn("lag", lag)
    return out.withColumn("long_run_variance", F.try_divide(total, F.col("n_valid").cast("double"))).drop("__sessions", *products)


def hac_mean(series: DataFrame, value: str, keys: Sequence[str], order: str, horizon: int, p_values: bool = True) -> DataFrame:
    """Mean with its HAC standard error, t, p-value and 95 % interval, or the reason against them."""
    rows = hac_sums(series, value, keys, order, horizon)
    reason = first_reason(
        (F.col("n_valid") == 0, "NO_VALID_OBSERVATIONS"),
        (F.col("n_valid") < 2, "INSUFFICIENT_OBSERVATIONS"),
        (~is_finite("long_run_variance") | (F.col("long_run_variance") <= 0), "NONPOSITIVE_LONG_RUN_VARIANCE"),
    )
    rows = rows.withColumn("invalid_reason", reason)
    rows = rows.withColumn("se", F.when(F.col("invalid_reason").isNull(), F.sqrt(F.col("long_run_variance") / F.col("n_valid"))))
    rows = rows.withColumn("t", F.try_divide("mean", "se"))
    half = F.lit(1.959963984540054) * F.col("se")
    rows = rows.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
    out = rows.select(*keys, "n_valid", "lag", "mean", "se", "t", "ci_low", "ci_high", "invalid_reason")
    return out.withColumn("p_value", normal_p_value("t")) if p_values else out


def adjusted_p_values(tests: DataFrame, family: str, p: str, order: str, rows: int = ROWS) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjusted p-values within each family (C28). Null p-values stay out and stay null.

    BH: least(1, running minimum from the largest rank down of p * n / rank), ranks by (p, order). The p-values are cut into
    ranges of about `rows`: ranks and minima run within a range, from its own end, and take on what the other ranges hold.
    """
    known = with_ranges(tests.where(is_finite(p)), p, rows)
    by, across = [family, "__range"], Window.partitionBy(family)
    inside, earlier, later = Window.partitionBy(*by), across.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), across.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy(*by).agg(F.count("*").alias("__size"))
    sizes = sizes.select(*by, F.sum("__size").over(across).alias("__n"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    ranked = met(known, sizes, by[:1]).withColumn("__rank", F.col("__before") + F.row_number().over(inside.orderBy(p, order)))
    ranked = ranked.withColumn("__scaled", F.col(p) * F.col("__n") / F.col("__rank"))
    lows = ranked.groupBy(*by).agg(F.min("__scaled").alias("__low"))
    lows = lows.select(*by, F.min("__low").over(later).alias("__later"))
    own = F.min("__scaled").over(inside.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    done = met(ranked.withColumn("__own", own), lows, by[:1])  # least passes over nulls
    done = done.select(*tests.columns, F.least(F.lit(1.0), F.col(p) * F.col("__n")).alias("bonferroni"), F.least(F.lit(1.0), "__own", "__later").alias("bh_fdr"))
    rest = tests.where(~is_finite(p))
    return done.unionByName(rest, allowMissingColumns=True)
