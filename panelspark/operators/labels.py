"""Forward-return labels and the executable state of instruments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import first_reason, is_finite
from panelspark.operators.relational import grid, small


def _session_map(sessions: DataFrame, horizon: int) -> DataFrame:
    """signal_date with the session after it and the one `horizon` later, over the calendar alone."""
    w = Window.orderBy("trade_date")
    s = sessions.select("trade_date").distinct()
    return s.select(F.col("trade_date").alias("signal_date"), F.lead("trade_date", 1).over(w).alias("return_start"), F.lead("trade_date", horizon).over(w).alias("return_end"))


def forward_returns(signals: DataFrame, sessions: DataFrame, bars: DataFrame, horizons: tuple[int, ...], state: DataFrame | None = None) -> DataFrame:
    """close(t + h) / open(t + 1) - 1 on the session axis, for each (signal_date, instrument_id) of signals.

    With state (instrument_id, trade_date, is_listed, is_suspended, entry_limit_up) the
    label is executable as well: listed, not suspended and not at its upper limit at
    entry (C8). A missing state counts as suspended and not listed at entry, and as
    listed at exit.
    """
    kind = "theoretical" if state is None else "executable"
    price = bars.select("instrument_id", "trade_date", "open", "close")

    def one(h: int) -> DataFrame:
        rows = signals.select("signal_date", "instrument_id").join(_session_map(sessions, h), "signal_date", "left")
        entry = price.select("instrument_id", F.col("trade_date").alias("return_start"), F.col("open").alias("entry_open"))
        leave = price.select("instrument_id", F.col("trade_date").alias("return_end"), F.col("close").alias("exit_close"))
        rows = rows.join(entry, ["instrument_id", "return_start"], "left").join(leave, ["instrument_id", "return_end"], "left")
        cases: list[tuple[Column, str]] = [(F.col("return_start").isNull() | F.col("return_end").isNull(), "INCOMPLETE_FORWARD_WINDOW")]
        gone = F.lit(False)
        if state is not None:
            at = lambda prefix, day: state.select("instrument_id", F.col("trade_date").alias(day), *[F.col(c).alias(f"{prefix}_{c}") for c in ("is_listed", "is_suspended", "entry_limit_up")])
            rows = rows.join(at("in", "return_start"), ["instrument_id", "return_start"], "left").join(at("out", "return_end"), ["instrument_id", "return_end"], "left")
            has = lambda c, default: F.coalesce(F.col(c), F.lit(default))
            cases += [(~has("in_is_listed", False), "NOT_LISTED_AT_ENTRY"), (has("in_is_suspended", True), "ENTRY_SUSPENDED"), (has("in_entry_limit_up", False), "ENTRY_LIMIT_UP")]
            gone = ~has("out_is_listed", True)
        missing = F.col("exit_close").isNull()
        cases += [
            (F.col("entry_open").isNull(), "MISSING_ENTRY_PRICE"),
            (missing & gone, "DELISTED_WITHOUT_EXIT_PRICE"),
            (missing, "MISSING_EXIT_PRICE"),
            (~is_finite(F.try_divide("exit_close", "entry_open")), "NONFINITE_RETURN"),
        ]
        rows = rows.withColumn("invalid_reason", first_reason(*cases))
        ok = F.col("invalid_reason").isNull()
        return rows.select(
            "signal_date", "instrument_id", F.lit(h).alias("horizon"), F.lit(kind).alias("label_kind"), "return_start", "return_end",
            F.when(ok, F.try_divide("exit_close", "entry_open") - 1).alias("future_return"), ok.alias("is_valid"), "invalid_reason",
        )

    return reduce(DataFrame.unionByName, map(one, horizons))


def limit_up_ticks(preclose_ticks: Column, numerator: Column, denominator: Column) -> Column:
    """preclose * numerator / denominator in whole ticks, halves up, on integers alone."""
    product = preclose_ticks * numerator
    return F.floor((product * 2 + denominator) / (denominator * 2)).cast("long")


def executable_state(instruments: DataFrame, sessions: DataFrame, bars: DataFrame, suspended: DataFrame, rate_percent: int = 10, free_sessions: int = 5) -> DataFrame:
    """is_listed, is_suspended and entry_limit_up of every instrument on every session.

    instruments: instrument_id, list_date, delist_date. bars: instrument_id, trade_date,
    open_ticks, preclose_ticks (whole price ticks). The first free_sessions sessions of
    an instrument have no limit.
    """
    cells = grid(instruments, sessions.select("trade_date").distinct())
    listed = (F.col("list_date") <= F.col("trade_date")) & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("trade_date")))
    age = F.sum(F.when(listed, 1).otherwise(0)).over(Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"is_listed": F.coalesce(listed, F.lit(False)), "__age": age})
    marked = suspended.select("instrument_id", "trade_date").distinct().withColumn("__suspended", F.lit(True))
    rows = cells.join(marked, ["instrument_id", "trade_date"], "left").join(bars.select("instrument_id", "trade_date", "open_ticks", "preclose_ticks"), ["instrument_id", "trade_date"], "left")
    limit = limit_up_ticks(F.col("preclose_ticks").cast("long"), F.lit(100 + rate_percent), F.lit(100))
    hit = (F.col("__age") > free_sessions) & (F.col("open_ticks") >= limit)
    return rows.select("instrument_id", "trade_date", "is_listed", F.coalesce("__suspended", F.lit(False)).alias("is_suspended"), F.coalesce(hit, F.lit(False)).alias("entry_limit_up"))
