"""Corporate actions and the trading calendar (D7, L2, L4-L6), set-based: entitlements are a join of events with holdings at the record close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.relational import latest, small

SPLIT_TOLERANCE = 0.001


def record_close(day: str = "record_date", hour: int = 15, zone_offset_hours: int = 8) -> Column:
    """15:00 in Shanghai (which keeps one offset) on a day, as a UTC time without zone."""
    return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour - zone_offset_hours))


def dividend_events(rows: DataFrame, start: Column, end: Column, keys: tuple[str, ...] = ("instrument_id", "report_period"), implemented: str = "IMPLEMENTED") -> DataFrame:
    """Implemented events recorded in a range and known by the record close, the latest revision of each key."""
    seen = F.col("available_at").isNotNull() & (F.col("available_at") <= record_close())
    known = rows.where((F.col("status") == implemented) & F.col("record_date").between(start, end) & seen & F.coalesce("pit_usable", F.lit(False)))
    return latest(known, list(keys), ["available_at", "revision"])


def next_session(calendar: DataFrame) -> DataFrame:
    """trade_date and the session after it, of a calendar's open days."""
    days = calendar.where("is_trading_day").select("trade_date").distinct()
    return days.withColumn("next_session", F.lead("trade_date").over(Window.orderBy("trade_date")))  # a calendar


def mapped_to_sessions(events: DataFrame, calendar: DataFrame, columns: dict[str, str]) -> DataFrame:
    """events with each official date moved to the first session at or after it (L4); null where there is none. columns: official to new name."""
    sessions = calendar.where("is_trading_day").select(F.col("trade_date").alias("day")).distinct()
    out = events
    for source, target in columns.items():
        days = sessions.withColumn("open", F.lit(True)).unionByName(events.select(F.col(source).alias("day")).distinct().withColumn("open", F.lit(False)))
        ahead = F.min(F.when(F.col("open"), F.col("day"))).over(Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing))
        found = days.groupBy("day").agg(F.bool_or("open").alias("open")).withColumn(target, ahead).select(F.col("day").alias(source), target)
        out = out.join(found.where(F.col(source).isNotNull()), source, "left")
    return out


def assembled_actions(dividends: DataFrame, splits: DataFrame, tolerance: float = SPLIT_TOLERANCE) -> DataFrame:
    """Dividends and splits as one table of events (L5); a split that is no whole ratio within the tolerance is an error."""
    d = dividends.select("instrument_id", F.lit("DIVIDEND").alias("action_type"), "record_date", "ex_date", "pay_date", "listing_date", F.coalesce("cash_per_share", F.lit(0.0)).alias("cash_per_share"), F.coalesce("stock_per_share", F.lit(0.0)).alias("stock_per_share"))
    checked = F.when(F.col("relative_error") > tolerance, F.raise_error(F.concat(F.lit("no whole split ratio: "), F.col("instrument_id").cast("string"))).cast("double")).otherwise(F.col("split_ratio"))
    day = F.col("trade_date")
    s = splits.select("instrument_id", F.lit("FUND_SPLIT").alias("action_type"), day.alias("record_date"), day.alias("ex_date"), day.alias("pay_date"), day.alias("listing_date"), F.lit(0.0).alias("cash_per_share"), checked.alias("stock_per_share"))
    return d.unionByName(s)


def entitlements(actions: DataFrame, holdings: DataFrame) -> DataFrame:
    """What each run's holding at the record close is due (L2): cash in cents, half up, and shares, floored.

    holdings: run_id, trade_date, instrument_id, quantity. A dividend adds stock_per_share
    shares a share, a split leaves stock_per_share times the holding. Cash accrues at
    the ex date and is paid at the pay date; shares can be sold from their listing date.
    """
    held = holdings.where("quantity > 0").withColumnRenamed("trade_date", "record_date")
    rows = actions.join(held, ["instrument_id", "record_date"])
    q = F.col("quantity").cast("decimal(18,0)")
    per = lambda c: F.col(c).cast("decimal(18,8)")
    cash = F.round(q * per("cash_per_share") * 100, 0).cast("long")
    shares = F.floor(q * per("stock_per_share")).cast("long") - F.when(F.col("action_type") == "FUND_SPLIT", F.col("quantity")).otherwise(F.lit(0)).cast("long")
    return rows.select("run_id", "instrument_id", "action_type", "record_date", "ex_date", "pay_date", "listing_date", "quantity", cash.alias("cash_cents"), shares.alias("new_shares"))


def receivables(due: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cash accrued but not yet paid of each run on each session (L2): the sum of what went ex by then less what was paid."""
    moves = due.select("run_id", F.col("ex_date").alias("trade_date"), F.col("cash_cents").alias("x")).unionByName(due.select("run_id", F.col("pay_date").alias("trade_date"), (-F.col("cash_cents")).alias("x")))
    days = due.select("run_id").distinct().crossJoin(small(sessions.select("trade_date").distinct())).withColumn("x", F.lit(0).cast("long"))
    per_day = moves.unionByName(days.select("run_id", "trade_date", "x")).groupBy("run_id", "trade_date").agg(F.sum("x").alias("x"))
    so_far = Window.partitionBy("run_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("dividend_receivable", F.sum("x").over(so_far)).drop("x")
