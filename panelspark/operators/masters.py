"""Masters, the trading calendar and the industry catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import text

#: Segments of a market that are boards of their own (fixed values).
SEGMENTS = {"growth": "CHINEXT", "science": "STAR"}


def instruments(raw: DataFrame) -> DataFrame:
    """instrument_id, exchange, board, list_date, delist_date of a delivered master; rows without a valid id are none.

    raw: code, market, list_date, delist_date, all strings. Boards are told by the id's ending,
    then by the market; dates that are none become null. Repeated ids stay, as delivered.
    """
    code = text.cleaned("code")
    board = F.when(F.endswith(code, F.lit(".BJ")), "BSE")
    for market, name in SEGMENTS.items():
        board = board.when(F.col("market") == market, name)
    return raw.where(text.is_code(code)).select(
        code.alias("instrument_id"), F.substring(code, 8, 2).alias("exchange"), board.otherwise("MAIN").alias("board"), text.to_day("list_date").alias("list_date"), text.to_day("delist_date").alias("delist_date")
    )


def is_listed(day: Column | str) -> Column:
    """Whether an instrument (list_date, delist_date) is listed on a day: from its first day on, until before the day it leaves. Never null."""
    day = F.col(day) if isinstance(day, str) else day
    return F.coalesce((F.col("list_date") <= day) & (F.col("delist_date").isNull() | (F.col("delist_date") > day)), F.lit(False))


def calendar(days: DataFrame, start: date, end: date) -> DataFrame:
    """Natural days from start to end, both included, with the open ones among them counted so far as `n_open`. days: trade_date, is_open."""
    if start > end:
        raise ValueError(f"the range begins on {start}, after its end on {end}")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return days.where(F.col("trade_date").between(F.lit(start), F.lit(end))).withColumn("n_open", F.count_if("is_open").over(w))


def listed_sessions(master: DataFrame, days: DataFrame, start: date, end: date) -> DataFrame:
    """master with `sessions`, the open days from start to end on which each instrument was listed.

    Two equi-joins with the calendar's running count, not one row a day and instrument.
    days must hold every natural day of the range. Without a list_date it is 0.
    """
    c = calendar(days, start, end).select("trade_date", "n_open", "is_open")
    first = F.greatest("list_date", F.lit(start))
    last = F.least(F.date_sub("delist_date", 1), F.lit(end))  # least and greatest pass over nulls
    at = lambda name: c.select(F.col("trade_date").alias(f"__{name}"), F.col("n_open").alias(f"__{name}_open"), F.col("is_open").cast("int").alias(f"__{name}_is"))
    rows = master.withColumns({"__a": F.when((first <= last) & F.col("list_date").isNotNull(), first), "__b": last})
    out = rows.join(at("a"), "__a", "left").join(at("b"), "__b", "left")
    n = F.col("__b_open") - F.col("__a_open") + F.col("__a_is")
    return out.select(*master.columns, F.coalesce(n, F.lit(0)).cast("long").alias("sessions"))


def industry_paths(catalog: DataFrame, levels: int = 3) -> DataFrame:
    """catalog with `path`, the codes from the first level down to each row's own, and `is_complete`, whether all of them are there. catalog: code, level, parent_code; code is unique.

    One equi-join for each level above a row. A row of a deeper level than `levels` is incomplete.
    """
    rows = catalog.withColumns({"path": F.col("code"), "__up": F.when(F.col("level") > 1, F.col("parent_code")), "__at": F.col("level")})
    for _ in range(levels - 1):
        parents = catalog.select(F.col("code").alias("__up"), F.col("parent_code").alias("__next"), F.col("level").alias("__level"))
        met = rows.join(parents, "__up", "left")
        found = F.coalesce(F.col("__level") == F.col("__at") - 1, F.lit(False))
        up = F.when(found & (F.col("__level") > 1), F.col("__next"))
        rows = met.select(*catalog.columns, F.when(found, F.concat_ws("/", "__up", "path")).otherwise(F.col("path")).alias("path"), up.alias("__up"), F.when(found, F.col("__level")).otherwise(F.col("__at")).alias("__at"))
    return rows.select(*catalog.columns, "path", F.coalesce(F.col("__at") == 1, F.lit(False)).alias("is_complete"))


def orphans(catalog: DataFrame, levels: Sequence[int] = (2, 3)) -> DataFrame:
    """Rows of these levels whose parent isn't there one level above."""
    up = catalog.select(F.col("code").alias("parent_code"), (F.col("level") + 1).alias("level"))
    return catalog.where(F.col("level").isin(*levels)).join(up, ["parent_code", "level"], "left_anti")
