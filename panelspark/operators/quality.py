"""Declarative data-quality rules (Q1-Q12): each rule is one aggregate of one dataset.

A rule counts violating rows. All rules of a dataset are computed in one pass, as columns
of one row; `run_rules` turns that row into PASS, FAIL and SKIPPED.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.numeric import any_true, is_finite

IDENTIFIER = r"^[0-9]{6}\.(SH|SZ|BJ)$"


@dataclass(frozen=True)
class Rule:
    """A named count of violations. requires: rules that must pass first. severity: SEVERE and FATAL block publication."""

    name: str
    violation: Callable[[], Column]
    severity: str = "SEVERE"
    requires: tuple[str, ...] = ()


def schema_differences(df: DataFrame, schema: StructType) -> list[str]:
    """What differs from the exact names, order and types (Q2)."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    return [f"column {i}: {a} instead of {b}" for i, (a, b) in enumerate(zip(have, want)) if a != b] + ([f"{len(have)} columns instead of {len(want)}"] if len(have) != len(want) else [])


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys more than one row has (Q3)."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_repeated_keys"))


def required_nulls(keys: Sequence[str], usable: str | None = None, at: str = "available_at") -> Column:
    """Rows with a null key, or usable without a time of availability (Q4)."""
    checks = [F.col(k).isNull() for k in keys]
    if usable:
        checks.append(F.col(usable) & F.col(at).isNull())
    return any_true(checks)


def bad_identifier(c: str, pattern: str = IDENTIFIER) -> Column:
    """A non-null id that doesn't match (Q5)."""
    return F.col(c).isNotNull() & ~F.col(c).rlike(pattern)


def traded() -> Column:
    return ~((F.coalesce("volume", F.lit(0.0)) == 0) & (F.coalesce("amount", F.lit(0.0)) == 0))


def bar_violations(tolerance: float = 0.001) -> dict[str, Column]:
    """Checks of traded bars (Q6): positive prices, the high-low envelope, no negative volume, and the stated change against close / preclose."""
    p = ("open", "high", "low", "close")
    stated = F.abs(F.try_divide("close", "preclose") - 1 - F.col("pct_change")) > tolerance
    return {
        "nonpositive_price": traded() & any_true([~(is_finite(c) & (F.col(c) > 0)) for c in p]),
        "price_envelope": traded() & any_true([F.col("high") < F.greatest(*p), F.col("low") > F.least(*p)]),
        "negative_volume": any_true([F.col("volume") < 0, F.col("amount") < 0]),
        "pct_change": traded() & F.coalesce(stated, F.lit(False)),
    }


def uncovered_days(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Open days up to the latest bar that have no bar (Q7)."""
    latest = F.broadcast(bars.agg(F.max("trade_date").alias("latest")))
    days = calendar.where("is_trading_day").join(latest, F.col("trade_date") <= F.col("latest")).select("trade_date")
    return days.join(bars.select("trade_date").distinct(), "trade_date", "left_anti")


def financial_violations() -> Column:
    """A report period that is no quarter end, or announced before it ended (Q8)."""
    end = F.last_day("report_period")
    return (F.col("report_period") != end) | (F.month("report_period") % 3 != 0) | (F.col("announcement_date") < F.col("report_period"))


def dividend_violations() -> dict[str, Column]:
    """Checks of dividend events (Q9)."""
    amounts = ("cash_per_share", "stock_per_share", "bonus_per_share", "conversion_per_share")
    done = F.col("status") == "IMPLEMENTED"
    later = lambda c: F.col(c).isNotNull() & (F.col(c) < F.col("ex_date"))
    return {
        "amounts": any_true([F.col(c).isNotNull() & ~(is_finite(c) & (F.col(c) >= 0)) for c in amounts]),
        "dates_missing": done & (F.col("record_date").isNull() | F.col("ex_date").isNull()),
        "seen_too_late": done & F.coalesce(F.col("available_at") > F.col("record_date").cast("timestamp_ntz") + F.expr("INTERVAL 15 HOURS"), F.lit(False)),
        "date_order": any_true([F.col("record_date") >= F.col("ex_date"), later("pay_date"), later("listing_date")]),
        "stock_parts": F.coalesce(F.abs(F.col("stock_per_share") - F.coalesce("bonus_per_share", F.lit(0.0)) - F.coalesce("conversion_per_share", F.lit(0.0))) > 1e-12, F.lit(False)),
    }


def industry_violations() -> Column:
    """Membership without a start, ended before it began, or with an end nobody knew of (Q10)."""
    return any_true([F.col("in_date").isNull(), F.col("in_available_at").isNull(), F.col("out_date") < F.col("in_date"), F.col("out_date").isNotNull() & F.col("out_available_at").isNull()])


def counts(df: DataFrame, violations: dict[str, Column]) -> DataFrame:
    """One row: n_rows and the violations of each rule, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(name) for name, v in violations.items()])


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, severity, n_violations, status and blocks of each rule (Q11): SKIPPED where a required rule doesn't pass, FAIL on an empty dataset for FATAL rules."""
    got = counts(df, {r.name: r.violation() for r in rules}).first().asDict()
    status: dict[str, str] = {}
    for r in rules:
        skipped = any(status.get(q) != "PASS" for q in r.requires)
        status[r.name] = "SKIPPED" if skipped else "FAIL" if got[r.name] or (r.severity == "FATAL" and not got["n_rows"]) else "PASS"
    rows = [(r.name, r.severity, None if status[r.name] == "SKIPPED" else got[r.name], status[r.name], status[r.name] == "FAIL" and r.severity in ("SEVERE", "FATAL")) for r in rules]
    return df.sparkSession.createDataFrame(rows, "rule string, severity string, n_violations long, status string, blocks boolean")


def freshness(watermarks: DataFrame, expected: Column, known: Column) -> DataFrame:
    """CURRENT, STALE, MISSING or UNKNOWN of each dataset by its newest business date (Q12). watermarks: dataset, watermark."""
    status = F.when(~known | expected.isNull(), "UNKNOWN").when(F.col("watermark").isNull(), "MISSING").when(F.col("watermark") >= expected, "CURRENT").otherwise("STALE")
    return watermarks.withColumn("status", status)


def watermark(df: DataFrame, dataset: str, date: str) -> DataFrame:
    return df.agg(F.lit(dataset).alias("dataset"), F.max(date).alias("watermark"))


def watermarks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
