"""Daily backtests (X1-X7, L1-L3): Spark prepares each order's market, a fold per run keeps the books.

All that doesn't depend on the run's state (market slice, limits, capacity, price,
ordered reasons) is joined and computed set-wise. The state (cash, lots, what may be
sold) is strictly sequential, so runs are the unit of parallel work: one group per
run, whose rows are that run's own orders and marks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import first_reason
from panelspark.operators.rules import COMMISSION_MINIMUM, COMMISSION_RATE, allowed_quantity, price_limits, profile_floor


def volume_capacity(volume: Column, participation: float) -> Column:
    """Shares that may be traded in a session."""
    return F.floor(volume * F.lit(float(participation))).cast("long")


def slipped_ticks(ticks: Column, side: Column, bps: int) -> Column:
    """A price moved against the trader, half up to the tick."""
    moved = lambda sign: F.round(ticks.cast("decimal(18,0)") * (10_000 + sign * bps) / F.lit(10_000).cast("decimal(6,0)"), 0).cast("long")
    return F.when(side == "BUY", moved(1)).otherwise(moved(-1))


def prepared_orders(orders: DataFrame, market: DataFrame, participation: float = 0.1, slippage_bps: int = 5) -> DataFrame:
    """orders with price, capacity, normalised quantity and the first reason against them that needs no books.

    orders: run_id, trade_date, instrument_id, side (BUY, SELL, SHORT_OPEN, SHORT_COVER),
    quantity, and `sellable` (what may be sold) where it is known; without it the reasons
    that depend on it are left to the fold. market: instrument_id, trade_date, limit_group,
    status, preclose_ticks, open_ticks, low_ticks, high_ticks, volume, is_suspended and the
    columns of a trading profile (`rules.with_profile`).
    A name is blocked at its limit only if it traded nowhere inside it: a buy where the
    low is at the upper limit, a sale where the high is at the lower one.
    """
    if "sellable" not in orders.columns:
        orders = orders.withColumn("sellable", F.lit(None).cast("long"))
    rows = orders.join(price_limits(market), ["instrument_id", "trade_date"], "left")
    side, quantity, sellable = F.col("side"), F.col("quantity"), F.col("sellable")
    capacity = F.coalesce(volume_capacity(F.col("volume"), participation), F.lit(0).cast("long"))
    buys, sells = side == "BUY", side == "SELL"
    unfit = F.when(buys | sellable.isNotNull(), ~allowed_quantity(side, quantity, sellable)).otherwise(F.lit(False))
    most = F.when(sells, F.least(quantity, capacity, F.coalesce(sellable, quantity))).otherwise(F.least(quantity, capacity))
    fitted = F.when(allowed_quantity(side, most, sellable), most).otherwise(profile_floor(side, most))
    rows = rows.withColumns({"capacity": capacity, "candidate": F.when((buys | sells) & F.col("buy_minimum").isNotNull(), fitted)})
    reason = first_reason(
        (F.coalesce("is_suspended", F.lit(False)), "SUSPENDED"),
        (F.col("open_ticks").isNull(), "NO_MARKET_DATA"),
        (side.isin("SHORT_OPEN", "SHORT_COVER"), "SHORT_NOT_SUPPORTED"),
        (unfit, "ODD_LOT"),
        (buys & (F.col("low_ticks") >= F.col("upper_ticks")), "LIMIT_UP_BUY_BLOCKED"),
        (sells & (F.col("high_ticks") <= F.col("lower_ticks")), "LIMIT_DOWN_SELL_BLOCKED"),
        (sells & (sellable == 0), "INSUFFICIENT_SELLABLE"),
        (F.col("capacity") == 0, "VOLUME_CAP"),
        ((F.col("candidate") == 0) & sells & sellable.isNotNull(), "INSUFFICIENT_SELLABLE"),
        ((F.col("candidate") == 0) & buys, "VOLUME_CAP"),
    )
    price = slipped_ticks(F.col("open_ticks"), side, slippage_bps)
    banded = F.least(F.greatest(price, F.coalesce("lower_ticks", price)), F.coalesce("upper_ticks", price))
    rows = rows.withColumns({"market_reason": reason, "price_ticks": F.when(buys | sells, banded)})
    return rows.select("run_id", "trade_date", "instrument_id", "side", "quantity", "price_ticks", "capacity", "candidate", "market_reason")


def commission(gross: int) -> int:
    """Cents, half up, at least the minimum."""
    rate = int(float(COMMISSION_RATE) * 1_000_000)
    return max((gross * rate + 500_000) // 1_000_000, COMMISSION_MINIMUM) if gross > 0 else 0


def affordable(cash: int, price: int, most: int, lot: int) -> int:
    """The largest multiple of lot up to most whose value and commission cash covers (X6): a search by halves, cost growing with quantity."""
    low, high = 0, most // lot
    while low < high:
        middle = (low + high + 1) // 2
        gross = middle * lot * price
        low, high = (middle, high) if gross + commission(gross) <= cash else (low, middle - 1)
    return low * lot


class Ledger:
    """Cash in cents and lots by instrument, first in first out; shares may be sold `settlement` sessions after they were bought (L1)."""

    def __init__(self, cash: int, settlement: int = 1):
        self.cash, self.settlement = cash, settlement
        self.lots: dict[int, deque[list[int]]] = {}  # [session bought, quantity, cost]
        self.total: dict[int, int] = {}

    def held(self, instrument: int) -> int:
        return self.total.get(instrument, 0)

    def sellable(self, instrument: int, session: int) -> int:
        """What is held but for the lots bought last, which aren't settled yet."""
        free = self.held(instrument)
        for lot in reversed(self.lots.get(instrument, ())):
            if lot[0] + self.settlement <= session:
                break
            free -= lot[1]
        return free

    def buy(self, instrument: int, session: int, quantity: int, gross: int, fees: int) -> None:
        self.cash -= gross + fees
        self.lots.setdefault(instrument, deque()).append([session, quantity, gross + fees])
        self.total[instrument] = self.held(instrument) + quantity

    def sell(self, instrument: int, session: int, quantity: int, gross: int, fees: int) -> int:
        """The realised profit; costs of split lots are shared half up."""
        self.cash += gross - fees
        self.total[instrument] -= quantity
        cost, left, lots = 0, quantity, self.lots[instrument]
        while left:
            lot = lots[0]
            n = min(left, lot[1])
            share = (2 * lot[2] * n + lot[1]) // (2 * lot[1])
            cost, left = cost + share, left - n
            lot[1], lot[2] = lot[1] - n, lot[2] - share
            if not lot[1]:
                lots.popleft()
        return gross - fees - cost


FILLS = "run_id long, trade_date date, instrument_id long, side string, requested long, filled long, price_ticks long, fees long, realized long, cash long, reason string"


def _fold(cash: int, lot: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: run, day, instrument, side, quantity, price in ticks, capacity, reason of the market."""
    ledger = Ledger(cash)
    ordered = sorted(rows, key=lambda r: (r[1], r[3] != "SELL", r[2], r[4]))
    days = {d: i for i, d in enumerate(dict.fromkeys(r[1] for r in ordered))}
    used: dict[tuple[int, int], int] = {}
    for run_id, day, instrument, side, quantity, ticks, capacity, market_reason in ordered:
        session, reason, n, fees, realized = days[day], market_reason, 0, 0, None
        if reason is None:
            room = int(capacity) - used.get((session, instrument), 0)
            price = int(ticks)
            if side == "SELL":
                free = ledger.sellable(instrument, session)
                n = min(quantity, free, room)
                reason = "SHORT_NOT_SUPPORTED" if not ledger.held(instrument) else "INSUFFICIENT_SELLABLE" if not free else "VOLUME_CAP" if room < min(quantity, free) else "FILLED"
            else:
                n = min(quantity, room) // lot * lot
                reason = "ODD_LOT" if quantity < lot else "VOLUME_CAP" if n < quantity // lot * lot else "FILLED"
                can = affordable(ledger.cash, price, n, lot)
                n, reason = can, "INSUFFICIENT_CASH" if can < n else reason
            n = max(n, 0)
            if n:
                gross = n * price
                fees = commission(gross)
                used[session, instrument] = used.get((session, instrument), 0) + n
                if side == "SELL":
                    realized = ledger.sell(instrument, session, n, gross, fees)
                else:
                    ledger.buy(instrument, session, n, gross, fees)
        yield run_id, day, instrument, side, quantity, n, ticks, fees, realized, ledger.cash, reason


def run_backtests(prepared: DataFrame, cash: int, lot: int = 100) -> DataFrame:
    """Fills of every run, sells before buys within a session (X1, X3, L1). prepared: see `prepared_orders`; a group is one run's orders."""

    columns = ["run_id", "trade_date", "instrument_id", "side", "quantity", "price_ticks", "capacity", "market_reason"]
    types = {"long": pa.int64(), "date": pa.date32(), "string": pa.string()}
    fields = [c.split() for c in FILLS.split(", ")]

    def fold(rows: pa.Table) -> pa.Table:
        days = rows["trade_date"].cast(pa.int32())
        done = zip(*_fold(cash, lot, zip(*[(days if c == "trade_date" else rows[c]).to_pylist() for c in columns])))
        return pa.table({c: pa.array(x, pa.int32()).cast(pa.date32()) if t == "date" else pa.array(x, types[t]) for (c, t), x in zip(fields, done)})

    return prepared.groupBy("run_id").applyInArrow(fold, FILLS)


def marked_to_market(fills: DataFrame, marks: DataFrame, cash: int) -> DataFrame:
    """Equity of each run on each session: cash after its last fill, and holdings at the last known price (L3). marks: trade_date, instrument_id, close_ticks.

    Cash and value change only where a run fills or a name that it trades has a price; what travels are these
    changes, as one row of lists for each run and name. They are summed up by run, and each
    stretch between two of them is spread over its sessions at the end, so that the grid of runs and sessions is never shuffled.
    """
    sessions = marks.agg(F.array_sort(F.collect_set("trade_date")).alias("sessions"))  # a calendar
    days = F.broadcast(sessions.select(F.posexplode("sessions").alias("at", "trade_date")).select((F.col("at") + 1).alias("at"), "trade_date"))
    sign = F.when(F.col("side") == "BUY", F.lit(1)).otherwise(F.lit(-1))
    on = F.col("at").isNotNull()
    moved = -sign * F.col("filled") * F.coalesce("price_ticks", F.lit(0)) - F.col("fees")
    no_long, no_price = F.lit(0).cast("long"), F.lit(None).cast(marks.schema["close_ticks"].dataType)
    flows = fills.join(days, "trade_date", "left").groupBy("run_id", "instrument_id").agg(F.collect_list(F.when(on, F.struct("at", (sign * F.col("filled")).alias("net"), moved.alias("change"), no_price.alias("close")))).alias("flows"))
    prices = marks.where("close_ticks is not null").join(days, "trade_date").groupBy("instrument_id").agg(F.collect_list(F.struct("at", no_long.alias("net"), no_long.alias("change"), F.col("close_ticks").alias("close"))).alias("prices"))
    # every run begins with the first session
    first = F.array(F.struct(F.lit(1).alias("at"), no_long.alias("net"), no_long.alias("change"), no_price.alias("close")))
    none = F.array().cast(prices.schema["prices"].dataType)
    both = flows.join(prices, "instrument_id", "left").select("run_id", "instrument_id", F.concat(first, "flows", F.coalesce("prices", none)).alias("changes"))
    rows = both.repartition("run_id").select("run_id", "instrument_id", F.inline("changes"))
    so_far = Window.partitionBy("run_id", "instrument_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum("net").over(so_far) * F.coalesce(F.last("close", ignorenulls=True).over(so_far), F.lit(0))
    each = Window.partitionBy("run_id", "instrument_id").orderBy("at")
    rows = rows.withColumn("value", value).withColumn("gain", F.col("value") - F.coalesce(F.lag("value").over(each), F.lit(0)))
    # rows of one session stay in their order, so that gains of a session add up to its last value
    by_run = rows.groupBy("run_id", "at").agg(F.sum("gain").alias("gain"), F.sum("change").alias("change"))
    axis = Window.partitionBy("run_id").orderBy("at")
    to_date = axis.rowsBetween(Window.unboundedPreceding, 0)
    books = by_run.select("run_id", "at", (F.sum("change").over(to_date) + cash).alias("cash"), F.sum("gain").over(to_date).alias("market_value"), F.lead("at").over(axis).alias("until"))
    spread = books.crossJoin(F.broadcast(sessions)).withColumn("length", F.coalesce("until", F.size("sessions") + 1) - F.col("at"))
    return spread.select("run_id", F.explode(F.slice("sessions", F.col("at"), F.col("length"))).alias("trade_date"), "cash", "market_value", (F.col("cash") + F.col("market_value")).alias("equity"))
