"""Reads of canonical datasets as they were known (S3-S8): filters only, so that they and the columns reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.factors import known_until
from panelspark.operators.relational import visible_at

#: A list of ids is written into the filter up to so many, and joined beyond.
IN_LIST = 500


def of_ids(df: DataFrame, ids: Sequence | DataFrame | None, column: str) -> DataFrame:
    """Rows of these ids: None means all, an empty list none."""
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        if len(ids) <= IN_LIST:
            return df.where(F.col(column).isin(*ids)) if ids else df.where(F.lit(False))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], df.select(column).schema)
    return df.join(ids.select(column).distinct(), column, "left_semi")


def between(df: DataFrame, start: str | None, end: str, day: str = "trade_date", usable: str | None = "pit_usable") -> DataFrame:
    """Rows from start (None: the first) to end, both included, that were usable and known by the end of the last day."""
    span = F.col(day) <= F.lit(end).cast("date")
    if start is not None:
        span = span & (F.col(day) >= F.lit(start).cast("date"))
    return visible_at(df.where(span), known_until(F.lit(end)), usable)


def bars_of(df: DataFrame, ids: Sequence | DataFrame, start: str, end: str, column: str = "instrument_id", day: str = "trade_date") -> DataFrame:
    """Bars, index bars or daily basics of some ids in a range."""
    return between(of_ids(df, ids, column), start, end, day)


def adjustment_factors(df: DataFrame, end: str, ids: Sequence | DataFrame | None = None, column: str = "instrument_id", day: str = "trade_date") -> DataFrame:
    """All factors up to a day, without a lower bound, so that an as-of join can reach back."""
    return between(of_ids(df, ids, column), None, end, day)
