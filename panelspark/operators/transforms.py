"""Cross-sectional transforms (C1-C6): each adds a value and a reason; rows are never dropped.

Groups are the cross-sections (as a rule a date). A row that was invalid stays so with
its reason, and takes no part in its group's statistics. Reasons in order: the row's own,
missing value, non-finite value, then those of each transform.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import first_reason, is_finite


def _with_input(df: DataFrame, value: str, more: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """df with __reason (null: takes part) and __v, the value of rows that take part."""
    upstream = F.col("invalid_reason") if "invalid_reason" in df.columns else F.lit(None).cast("string")
    flagged = ~F.coalesce(F.col("is_valid"), F.lit(False)) if "is_valid" in df.columns else F.lit(False)
    own = F.when(flagged, F.coalesce(upstream, F.lit("INPUT_INVALID")))
    checks = first_reason((F.col(value).isNull(), "MISSING_VALUE"), (~is_finite(value), "NONFINITE_VALUE"), *more)
    out = df.withColumn("__reason", F.coalesce(own, checks))
    return out.withColumn("__v", F.when(F.col("__reason").isNull(), F.col(value).cast("double")))


def _done(df: DataFrame, columns: Sequence[str], result: str, value: Column, reason: Column) -> DataFrame:
    out = df.withColumn("__result", value).withColumn("__final", F.coalesce("__reason", reason))
    ok = F.col("__final").isNull()
    kept = [c for c in columns if c not in (result, "is_valid", "invalid_reason")]
    return out.select(*kept, F.when(ok, F.col("__result")).alias(result), ok.alias("is_valid"), F.col("__final").alias("invalid_reason"))


def winsorize_mad(df: DataFrame, value: str, groups: Sequence[str], result: str = "winsorized", n: float = 3.0, least: int = 3) -> DataFrame:
    """Clips to median +- n * MAD of the group's valid rows; MAD 0 leaves values as they are."""
    w = Window.partitionBy(*groups)
    rows = _with_input(df, value).withColumn("__m", F.median("__v").over(w)).withColumn("__n", F.count("__v").over(w))
    rows = rows.withColumn("__mad", F.median(F.abs(F.col("__v") - F.col("__m"))).over(w))
    clipped = F.greatest(F.least("__v", F.col("__m") + F.col("__mad") * n), F.col("__m") - F.col("__mad") * n)
    return _done(rows, df.columns, result, F.when(F.col("__mad") == 0, F.col("__v")).otherwise(clipped), first_reason((F.col("__n") < least, "INSUFFICIENT_CROSS_SECTION")))


def zscore(df: DataFrame, value: str, groups: Sequence[str], result: str = "zscore") -> DataFrame:
    """(v - mean) / population std of the group's valid rows, computed on v / max|v| so that nothing overflows."""
    w = Window.partitionBy(*groups)
    rows = _with_input(df, value).withColumn("__scale", F.max(F.abs("__v")).over(w))
    rows = rows.withColumn("__s", F.coalesce(F.try_divide("__v", "__scale"), F.col("__v")))
    rows = rows.withColumns({"__mean": F.avg("__s").over(w), "__std": F.stddev_pop("__s").over(w), "__flat": F.max("__v").over(w) == F.min("__v").over(w)})
    reason = first_reason((F.col("__flat") | (F.col("__std") == 0), "ZERO_VARIANCE"))
    return _done(rows, df.columns, result, F.try_divide(F.col("__s") - F.col("__mean"), F.col("__std")), reason)


def neutralize_industry(df: DataFrame, value: str, groups: Sequence[str], industry: str, result: str = "neutralized") -> DataFrame:
    """v less its industry's mean in the group; a row alone in its industry is invalid, an empty industry is missing."""
    missing = F.col(industry).isNull() | (F.trim(F.col(industry).cast("string")) == "")
    rows = _with_input(df, value, [(missing, "MISSING_INDUSTRY")])
    w = Window.partitionBy(*groups, industry)
    rows = rows.withColumns({"__mean": F.avg("__v").over(w), "__n": F.count("__v").over(w)})
    return _done(rows, df.columns, result, F.col("__v") - F.col("__mean"), first_reason((F.col("__n") < 2, "SINGLE_MEMBER_INDUSTRY")))


def _cap_reasons(cap: str) -> list[tuple[Column, str]]:
    return [(F.col(cap).isNull(), "MISSING_MARKET_CAP"), (~is_finite(cap), "NONFINITE_MARKET_CAP"), (F.col(cap) <= 0, "NONPOSITIVE_MARKET_CAP")]


def _residual(rows: DataFrame, groups: Sequence[str], columns: Sequence[str], result: str, least: int, reason: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """v less its regression on x (with intercept) in the group, on centred moments. rows: __v and __x, null where a row takes no part."""
    w = Window.partitionBy(*groups)
    rows = rows.withColumns({"__n": F.count("__v").over(w), "__vm": F.avg("__v").over(w), "__xm": F.avg("__x").over(w)})
    dv, dx = F.col("__v") - F.col("__vm"), F.col("__x") - F.col("__xm")
    rows = rows.withColumns({"__sxy": F.sum(dv * dx).over(w), "__sxx": F.sum(dx * dx).over(w), "__flat": F.max("__x").over(w) == F.min("__x").over(w)})
    checks = first_reason(*reason, (F.col("__n") < least, "INSUFFICIENT_CROSS_SECTION"), (F.col("__flat") | (F.col("__sxx") == 0), "ZERO_MARKET_CAP_VARIANCE"))
    return _done(rows, columns, result, dv - F.try_divide("__sxy", "__sxx") * dx, checks)


def neutralize_market_cap(df: DataFrame, value: str, groups: Sequence[str], cap: str, result: str = "neutralized", least: int = 3) -> DataFrame:
    """Residual of v on ln(cap) with intercept (C4)."""
    rows = _with_input(df, value, _cap_reasons(cap))
    rows = rows.withColumn("__x", F.when(F.col("__v").isNotNull(), F.ln(F.col(cap).cast("double"))))
    return _residual(rows, groups, df.columns, result, least)


def neutralize_industry_market_cap(df: DataFrame, value: str, groups: Sequence[str], industry: str, cap: str, result: str = "neutralized", least: int = 3) -> DataFrame:
    """Residual of v on ln(cap), both less their industry's mean."""
    missing = F.col(industry).isNull() | (F.trim(F.col(industry).cast("string")) == "")
    rows = _with_input(df, value, [*_cap_reasons(cap), (missing, "MISSING_INDUSTRY")])
    w = Window.partitionBy(*groups, industry)
    rows = rows.withColumn("__x", F.when(F.col("__v").isNotNull(), F.ln(F.col(cap).cast("double"))))
    rows = rows.withColumns({"__many": F.count("__v").over(w), "__vi": F.avg("__v").over(w), "__xi": F.avg("__x").over(w)})
    alone = F.col("__many") < 2
    # a row alone in its industry is invalid and stays out of the regression
    rows = rows.withColumns({"__v": F.when(~alone, F.col("__v") - F.col("__vi")), "__x": F.when(~alone, F.col("__x") - F.col("__xi"))})
    return _residual(rows, groups, df.columns, result, least, [(alone, "SINGLE_MEMBER_INDUSTRY")])


def minimum_mask(df: DataFrame, groups: Sequence[str], least: int = 30) -> DataFrame:
    """Invalidates groups with fewer than `least` valid rows."""
    few = F.count_if("is_valid").over(Window.partitionBy(*groups)) < least
    rows = df.withColumn("__few", few)
    hit = F.col("__few") & F.col("is_valid")
    changes = {"invalid_reason": F.when(hit, "INSUFFICIENT_CROSS_SECTION").otherwise(F.col("invalid_reason")), "value": F.when(~hit, F.col("value")), "is_valid": F.col("is_valid") & ~F.col("__few")}
    return rows.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in df.columns])
