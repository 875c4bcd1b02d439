"""Market review (M1-M7): coverage, index panel, liquidity, breadth, limit sentiment, industries and valuation of a day, over all days at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import first_reason, is_finite, ratio
from panelspark.operators.masters import is_listed
from panelspark.operators.windows import by

#: Edges of the breadth buckets, in percent of change.
EDGES = (-7.0, -5.0, -3.0, 0.0, 3.0, 5.0, 7.0)


def index_panel(bars: DataFrame) -> DataFrame:
    """1, 5 and 20 session returns, amplitude and the series rebased to 100 (M2)."""
    w = by("instrument_id", "trade_date")
    back = lambda n: F.try_divide("close", F.lag("close", n).over(w)) - 1
    first = F.first("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.select("instrument_id", "trade_date", back(1).alias("return_1"), back(5).alias("return_5"), back(20).alias("return_20"), F.try_divide(F.col("high") - F.col("low"), F.lag("close").over(w)).alias("amplitude"), (F.try_divide("close", first) * 100).alias("rebased"))


def liquidity(bars: DataFrame) -> DataFrame:
    """Total amount of each session, its change, averages of 5 and 20, and its percentile among the last 20 (M3)."""
    totals = bars.groupBy("trade_date").agg(F.sum("amount").alias("amount"))
    w = Window.orderBy("trade_date")  # one row per session
    last = w.rowsBetween(-19, 0)
    many = F.collect_list("amount").over(last)
    rows = totals.withColumns({"change": ratio("amount", F.lag("amount").over(w)) - 1, "average_5": F.avg("amount").over(w.rowsBetween(-4, 0)), "average_20": F.avg("amount").over(last), "__last": many})
    below = F.size(F.filter("__last", lambda x: x <= F.col("amount")))
    return rows.withColumn("percentile_20", F.try_divide(below.cast("double"), F.size("__last").cast("double"))).drop("__last")


def breadth(changes: DataFrame, edges: Sequence[float] = EDGES) -> DataFrame:
    """Rising, falling and flat instruments, five quantiles and the buckets of change of each session (M4). changes: trade_date, change (in percent)."""
    c = F.when(is_finite("change"), F.col("change"))
    buckets = [F.count_if(c < edges[0]).alias("bucket_0")]
    buckets += [F.count_if((c >= a) & (c < b)).alias(f"bucket_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]), 1)]
    buckets.append(F.count_if(c >= edges[-1]).alias(f"bucket_{len(edges)}"))
    return changes.groupBy("trade_date").agg(F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"), *[F.percentile(c, p / 100).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)], *buckets)


def limit_state(open_: Column, high: Column, low: Column, close: Column, upper: Column, lower: Column) -> Column:
    """ONE_PRICE_LIMIT_UP, LIMIT_UP, LIMIT_DOWN or BROKEN_LIMIT_UP of a bar in ticks (M5)."""
    return first_reason(
        ((close >= upper) & (low >= upper) & (open_ >= upper), "ONE_PRICE_LIMIT_UP"),
        (close >= upper, "LIMIT_UP"),
        (close <= lower, "LIMIT_DOWN"),
        (high >= upper, "BROKEN_LIMIT_UP"),
    )


def limit_sentiment(rows: DataFrame) -> DataFrame:
    """Counts of limit states of each session, and of rows whose limits are unknown (M5). rows: trade_date, *_ticks, upper_ticks, lower_ticks."""
    state = limit_state(*[F.col(f"{c}_ticks") for c in ("open", "high", "low", "close")], F.col("upper_ticks"), F.col("lower_ticks"))
    known = F.col("upper_ticks").isNotNull() & F.col("lower_ticks").isNotNull()
    out = rows.withColumns({"__s": F.when(known, state), "__known": known})
    n = lambda *s: F.count_if(F.col("__s").isin(*s))
    return out.groupBy("trade_date").agg(
        n("ONE_PRICE_LIMIT_UP", "LIMIT_UP").alias("limit_up"), n("ONE_PRICE_LIMIT_UP").alias("one_price"), n("LIMIT_DOWN").alias("limit_down"), n("BROKEN_LIMIT_UP").alias("broken"), F.count_if(~F.col("__known")).alias("unresolved")
    )


def industry_table(rows: DataFrame) -> DataFrame:
    """Members, equal-weight change, share of rising members and share of the day's amount of each industry (M6). rows: trade_date, industry, change, amount."""
    c = F.when(is_finite("change"), F.col("change"))
    sums = rows.groupBy("trade_date", "industry").agg(F.count(c).alias("members"), F.avg(c).alias("mean_change"), F.try_divide(F.count_if(c > 0).cast("double"), F.count(c).cast("double")).alias("advance_rate"), F.sum("amount").alias("amount"))
    return sums.withColumn("amount_share", F.try_divide("amount", F.sum("amount").over(Window.partitionBy("trade_date"))))


def valuation(rows: DataFrame, value: str, keys: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Count and quantiles of the positive finite values (M7)."""
    v = F.when(is_finite(value) & (F.col(value) > 0), F.col(value))
    return rows.groupBy(*keys).agg(F.count(v).alias("n_values"), *[F.percentile(v, p / 100).alias(f"p{p:02d}") for p in (10, 25, 50, 75, 90)])


def day_coverage(listed: DataFrame, warned: DataFrame, bars: DataFrame) -> DataFrame:
    """Listed, reviewed (not under a risk warning) and priced instruments of each session (M1). listed, warned: trade_date, instrument_id; bars: with close."""
    keys = ["trade_date", "instrument_id"]
    marked = warned.select(*keys).distinct().withColumn("__warned", F.lit(True))
    rows = listed.select(*keys).distinct().join(marked, keys, "left").join(bars.select(*keys, "close"), keys, "left")
    kept = F.col("__warned").isNull()
    priced = kept & is_finite("close") & (F.col("close") > 0)
    out = rows.groupBy("trade_date").agg(F.count("*").alias("listed"), F.count_if(kept).alias("reviewed"), F.count_if(priced).alias("priced"))
    return out.withColumn("coverage", F.try_divide(F.col("priced").cast("double"), F.col("reviewed").cast("double")))


def market_review(master: DataFrame, sessions: DataFrame, bars: DataFrame, suspended: DataFrame, warned: DataFrame, exclude_warned: bool = True) -> DataFrame:
    """The review of every session in one row: counts and coverage of the data, breadth and liquidity (M1, M3, M4).

    master: instrument_id (unique), list_date, delist_date. sessions: distinct trade_date. bars:
    unique trade_date, instrument_id with open, high, low, close, preclose, change, amount.
    suspended, warned: trade_date, instrument_id. Instruments under a warning are left out
    if exclude_warned. A bar is priced if it isn't suspended and all its prices and its change are
    finite; missing are listed instruments that are neither suspended nor priced; coverage is null where nothing is expected.

    How many are listed is a running sum of listings and leavings over the calendar, so no row a session and
    instrument is made: work grows with the bars, the states and the master.
    """
    keys = ["trade_date", "instrument_id"]
    dates = master.select("instrument_id", "list_date", "delist_date").where("list_date is not null and (delist_date is null or delist_date > list_date)")
    moves = dates.select(F.col("list_date").alias("trade_date"), F.lit(1).alias("n")).union(dates.where("delist_date is not null").select("delist_date", F.lit(-1)))
    steps = moves.union(sessions.select("trade_date", F.lit(0))).groupBy("trade_date").agg(F.sum("n").alias("n"))
    running = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    listed = steps.withColumn("listed", F.sum("n").over(running)).join(sessions.select("trade_date").distinct(), "trade_date", "left_semi").select("trade_date", "listed")

    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    states = flag(suspended, "__s").join(flag(warned, "__w"), keys, "full")
    rows = bars.select(*keys, "open", "high", "low", "close", "preclose", "change", "amount").withColumn("__bar", F.lit(True)).join(states, keys, "full")
    rows = rows.join(sessions.select("trade_date").distinct(), "trade_date", "left_semi").join(dates, "instrument_id").where(is_listed("trade_date"))
    kept = F.lit(True) if not exclude_warned else F.col("__w").isNull()
    whole = F.col("__bar") & F.col("__s").isNull()
    for c in ("open", "high", "low", "close", "preclose", "change"):
        whole = whole & is_finite(c)
    rows = rows.withColumns({"__kept": kept, "__priced": F.coalesce(kept & whole, F.lit(False))})
    counts = rows.groupBy("trade_date").agg(F.count_if("__priced").alias("priced_count"), F.count_if(kept & F.col("__s").isNotNull()).alias("suspended_count"), F.count_if("__w").alias("__warned"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = listed.join(counts, "trade_date", "left")
    out = out.select("trade_date", (zero("listed") - (zero("__warned") if exclude_warned else F.lit(0))).cast("long").alias("expected_count"), zero("priced_count").alias("priced_count"), zero("suspended_count").alias("suspended_count"), (F.lit(0) if exclude_warned else zero("__warned")).cast("long").alias("st_count"))
    due = F.col("expected_count") - F.col("suspended_count")
    out = out.withColumns({"missing_bar_count": F.greatest(due - F.col("priced_count"), F.lit(0)).cast("long"), "coverage_rate": F.when(due > 0, F.col("priced_count") / due)})

    amounts = rows.where(F.col("__bar") & F.col("__kept")).select("trade_date", F.when(is_finite("amount"), F.col("amount")).otherwise(0.0).alias("amount"))
    traded = liquidity(amounts.union(sessions.select("trade_date", F.lit(0.0))))
    spread = breadth(rows.where("__priced").select("trade_date", "change"))
    counted = [c for c, t in spread.dtypes if t == "bigint"]
    return out.join(spread, "trade_date", "left").fillna(0, subset=counted).join(traded, "trade_date")
