"""Price adjustment and session-complete returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import is_finite
from panelspark.operators.relational import asof_backward, grid


def is_placeholder() -> Column:
    """A bar without volume and amount: the instrument was not traded."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    return zero("volume") & zero("amount")


def adjust_forward(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Traded bars with prices on the scale of the instrument's last factor.

    open, high, low, close times f / f_end and preclose times f_prev / f_end, where f is
    the factor as of the day, f_prev the one strictly before it (default f) and f_end the
    instrument's last. Rows with a factor or close that is not finite and positive carry
    `is_valid` false.
    """
    f = factors.select("instrument_id", "trade_date", "adjustment_factor")
    rows = bars.where(~is_placeholder())
    rows = asof_backward(rows, f, ["instrument_id"], "trade_date", ["adjustment_factor"]).drop("trade_date_matched")
    before = f.withColumnRenamed("adjustment_factor", "previous_factor")
    rows = asof_backward(rows, before, ["instrument_id"], "trade_date", ["previous_factor"], strict=True).drop("trade_date_matched")
    last = f.groupBy("instrument_id").agg(F.max_by("adjustment_factor", "trade_date").alias("end_factor"))
    rows = rows.join(last, "instrument_id", "left")
    previous = F.coalesce("previous_factor", "adjustment_factor")
    good = lambda c: is_finite(c) & (F.col(c) > 0)
    ok = good("adjustment_factor") & good("end_factor") & good("close")
    scale = F.when(ok, F.col("adjustment_factor") / F.col("end_factor"))
    prices = {f"adj_{c}": F.col(c) * scale for c in ("open", "high", "low", "close") if c in bars.columns}
    if "preclose" in bars.columns:
        prices["adj_preclose"] = F.col("preclose") * F.when(ok, previous / F.col("end_factor"))
    return rows.withColumns(prices).withColumn("is_valid", ok).drop("previous_factor", "end_factor")


def log_return(close: str = "adj_close", preclose: str = "adj_preclose") -> Column:
    """ln(close) - ln(preclose); null where either is not positive (D3)."""
    return F.ln(F.when(F.col(close) > 0, F.col(close))) - F.ln(F.when(F.col(preclose) > 0, F.col(preclose)))


def session_grid(instruments: DataFrame, sessions: DataFrame, returns: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Every instrument on every session (D4): its return where it traded, 0 on an observed placeholder, null where there is no row."""
    cells = grid(instruments.select("instrument_id"), sessions.select("trade_date"))
    keys = ["instrument_id", "trade_date"]
    marked = placeholders.select(*keys).distinct().withColumn("__placeholder", F.lit(True))
    met = cells.join(returns.select(*keys, "log_return"), keys, "left").join(marked, keys, "left")
    return met.select(*keys, F.coalesce("log_return", F.when(F.col("__placeholder"), F.lit(0.0))).alias("log_return"))


def lookback_start(calendar: DataFrame, start: Column, n: int) -> DataFrame:
    """The session n before the first session at or after start (D5), one row; the calendar's first if there are fewer."""
    w = Window.orderBy("trade_date")  # a calendar: a few thousand rows
    sessions = calendar.where("is_trading_day").select("trade_date", F.row_number().over(w).alias("i"))
    first = sessions.where(F.col("trade_date") >= start).agg(F.min("i").alias("first"))
    return sessions.join(F.broadcast(first), F.col("i") >= F.greatest(F.col("first") - n, F.lit(1))).agg(F.min("trade_date").alias("lookback_start"))


def inferred_splits(factors: DataFrame, start: Column, end: Column, cash_events: DataFrame, least: float = 1.5) -> DataFrame:
    """Fund splits read off jumps of the adjustment factor.

    The ratio to the factor before (looked up before the date range is applied) above
    `least` is a split of the nearest whole number, with its relative error; days with a
    cash distribution are left out.
    """
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = factors.withColumn("previous_factor", F.lag("adjustment_factor").over(w))
    ratio = F.try_divide("adjustment_factor", "previous_factor")
    rows = rows.withColumn("ratio", ratio).where(F.col("trade_date").between(start, end) & (F.col("ratio") > least))
    rows = rows.withColumn("split_ratio", F.round("ratio", 0)).withColumn("relative_error", F.abs(F.col("ratio") / F.col("split_ratio") - 1))
    paid = cash_events.select("instrument_id", F.col("ex_date").alias("trade_date")).distinct()
    return rows.join(paid, ["instrument_id", "trade_date"], "left_anti").select("instrument_id", "trade_date", "ratio", "split_ratio", "relative_error")
