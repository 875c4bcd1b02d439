"""Universe, signals, portfolio construction, risk and cost (U*, G*, B*, K*): set-based over all dates at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import finite, is_finite
from panelspark.operators.relational import asof_backward, content_hash, grid, small
from panelspark.operators.transforms import winsorize_mad, zscore
from panelspark.operators.windows import by, rolling_mean, rolling_std

BOARDS = ("MAIN", "CHINEXT", "STAR")


# --- universe -------------------------------------------------------------------


def _reasons(cases: Sequence[tuple[Column, str]]) -> Column:
    """All reasons that apply, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, r in cases]))


def batch_universe(instruments: DataFrame, sessions: DataFrame, statuses: DataFrame, least_sessions: int = 120, boards: Sequence[str] = BOARDS) -> DataFrame:
    """Eligibility of every instrument on every session with all reasons against it.

    instruments: instrument_id, list_date, delist_date, board, metadata_present,
    listing_ordinal (of the first session); sessions: signal_date, session_ordinal;
    statuses: signal_date, instrument_id, is_risk_warning, is_suspended (absent: neither).
    """
    rows = grid(instruments, sessions).join(statuses, ["signal_date", "instrument_id"], "left")
    day = F.col("signal_date")
    reasons = _reasons(
        [
            (~F.coalesce("metadata_present", F.lit(False)), "INSTRUMENT_HISTORY_MISSING"),
            (F.col("list_date") > day, "NOT_LISTED_YET"),
            (F.col("delist_date") <= day, "DELISTED"),
            (F.col("session_ordinal") - F.col("listing_ordinal") + 1 < least_sessions, "INSUFFICIENT_LISTING_DAYS"),
            (F.col("is_risk_warning"), "RISK_WARNING"),
            (F.col("is_suspended"), "SUSPENDED"),
            (~F.coalesce(F.col("board").isin(*boards), F.lit(False)), "BOARD_NOT_ALLOWED"),
        ]
    )
    return rows.withColumn("reasons", reasons).select("signal_date", "instrument_id", (F.size("reasons") == 0).alias("eligible"), "reasons")


def liquidity_universe(universe: DataFrame, amounts: DataFrame, sessions: int = 20, least: float = 0.0) -> DataFrame:
    """Adds the liquidity reasons of a single-date universe (U1): the mean amount of the last sessions rows up to the date. amounts: instrument_id, trade_date, amount."""
    w = by("instrument_id", "trade_date")
    frame = w.rowsBetween(-(sessions - 1), 0)
    stats = amounts.select(
        "instrument_id", F.col("trade_date").alias("signal_date"), F.row_number().over(w).alias("n_rows"), F.count(finite("amount")).over(frame).alias("n_amounts"), F.avg(finite("amount")).over(frame).alias("mean_amount")
    )
    rows = universe.join(stats, ["signal_date", "instrument_id"], "left")
    more = _reasons(
        [
            (F.coalesce("n_rows", F.lit(0)) < sessions, "INSUFFICIENT_LIQUIDITY_HISTORY"),
            (F.col("n_rows").isNull(), "MISSING_LIQUIDITY_OBSERVATIONS"),
            (F.col("n_amounts") < F.least("n_rows", F.lit(sessions)), "LIQUIDITY_AMOUNT_MISSING"),
            ((F.col("n_amounts") == sessions) & (F.col("mean_amount") < least), "INSUFFICIENT_AVERAGE_AMOUNT"),
        ]
    )
    rows = rows.withColumn("reasons", F.concat("reasons", more))
    return rows.select("signal_date", "instrument_id", (F.size("reasons") == 0).alias("eligible"), "reasons")


def universe_identity(universe: DataFrame) -> DataFrame:
    """An order-free hash of the eligible rows of each date."""
    return content_hash(universe.where("eligible").select("signal_date", "instrument_id"), ["signal_date"])


# --- signals --------------------------------------------------------------------


def multifactor_score(factors: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of z-scores (population std) per date, weights over their absolute sum; null unless all factors are there (G1)."""
    total = sum(abs(w) for w in weights.values())
    table = factors.sparkSession.createDataFrame([(k, v / total) for k, v in weights.items()], "factor_id string, weight double")
    z = zscore(factors.where(F.col("factor_id").isin(*weights)), "value", ["signal_date", "factor_id"], "z").join(F.broadcast(table), "factor_id")
    sums = z.groupBy("signal_date", "instrument_id").agg(F.count_if("is_valid").alias("n"), F.sum(F.col("z") * F.col("weight")).alias("s"))
    whole = F.col("n") == len(weights)
    return sums.select("signal_date", "instrument_id", F.when(whole, F.col("s")).alias("score"), F.when(~whole, "INCOMPLETE_FACTOR_SET").alias("invalid_reason"))


def dual_ma(bars: DataFrame, short: int, long: int) -> DataFrame:
    """LONG where the short moving average is above the long one, else FLAT, and whether that changed."""
    w = by("instrument_id", "trade_date")
    rows = bars.withColumns({"short_ma": rolling_mean("close", w, short), "long_ma": rolling_mean("close", w, long)})
    ok = F.col("short_ma").isNotNull() & F.col("long_ma").isNotNull()
    rows = rows.withColumn("direction", F.when(ok, F.when(F.col("short_ma") > F.col("long_ma"), "LONG").otherwise("FLAT")))
    before = F.lag("direction").over(w)
    change = F.coalesce(before.isNotNull() & F.col("direction").isNotNull() & (before != F.col("direction")), F.lit(False))
    return rows.select("instrument_id", F.col("trade_date").alias("signal_date"), "direction", change.alias("changed"), F.when(~ok, "INSUFFICIENT_MA_WINDOW").alias("invalid_reason"))


def rotation(bars: DataFrame, windows: dict[int, float], trend: int, vol: int, penalty: float, n: int, strategy: bool = False) -> DataFrame:
    """Rotation among instruments (G3): score = weighted returns - penalty * volatility; those below their trend average are out, the n best share equally.

    Returns look back `window` rows; the strategy form (G4) counts the window's own rows,
    so it looks back one less.
    """
    w = by("instrument_id", "trade_date")
    rows = bars.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1)
    back = 1 if strategy else 0
    parts = [(F.try_divide("close", F.lag("close", k - back).over(w)) - 1) * F.lit(float(x)) for k, x in windows.items()]
    score = sum(parts[1:], parts[0]) - rolling_std("r", w, vol) * F.lit(float(penalty))
    above = F.try_divide("close", rolling_mean("close", w, trend)) - 1
    rows = rows.withColumns({"score": score, "trend": above})
    known = is_finite("score") & is_finite("trend")
    rows = rows.withColumn("invalid_reason", F.when(~known, "INSUFFICIENT_ROTATION_WINDOW")).withColumn("in_play", known & (F.col("trend") > 0))
    best = Window.partitionBy("trade_date").orderBy(F.col("in_play").desc(), F.col("score").desc(), "instrument_id")
    rows = rows.withColumn("rank", F.row_number().over(best)).withColumn("chosen", F.col("in_play") & (F.col("rank") <= n))
    many = F.count_if("chosen").over(Window.partitionBy("trade_date"))
    return rows.select(F.col("trade_date").alias("signal_date"), "instrument_id", "score", F.when(F.col("chosen"), F.lit(1.0) / many).otherwise(0.0).alias("weight"), "invalid_reason")


def multifactor_strategy(factors: DataFrame, weights: dict[str, float], least_factors: int) -> DataFrame:
    """Scores on the last session of each ISO week (G6): winsorized z-scores per (date, factor), weighted over those that are valid."""
    last = factors.groupBy(F.extract(F.lit("YEAROFWEEK"), "signal_date").alias("y"), F.weekofyear("signal_date").alias("w")).agg(F.max("signal_date").alias("signal_date")).select("signal_date")
    rows = factors.where(F.col("factor_id").isin(*weights)).join(last, "signal_date", "left_semi")
    keys = ["signal_date", "factor_id"]
    z = zscore(winsorize_mad(rows, "value", keys, "w"), "w", keys, "z")
    table = factors.sparkSession.createDataFrame(list(weights.items()), "factor_id string, weight double")
    z = z.join(F.broadcast(table), "factor_id")
    sums = z.groupBy("signal_date", "instrument_id").agg(F.count_if("is_valid").alias("n_valid"), F.coalesce(F.sum(F.when(F.col("is_valid"), F.col("z") * F.col("weight"))), F.lit(0.0)).alias("s"))
    ok = F.col("n_valid") >= least_factors
    return sums.select("signal_date", "instrument_id", "n_valid", F.when(ok, F.col("s")).alias("score"), F.when(~ok, "INSUFFICIENT_VALID_FACTORS").alias("invalid_reason"))


# --- portfolio ------------------------------------------------------------------


def equal_weight(candidates: DataFrame, n: int, cap: float, least_adv: float, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """The n best by (-score, id) above a floor of traded amount, equally weighted up to cap; what is left is cash (B1). candidates: keys, instrument_id, score, adv_amount, current_weight."""
    fit = is_finite("score") & (F.col("adv_amount") >= least_adv)
    rows = candidates.withColumn("fit", F.coalesce(fit, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.col("fit").desc(), F.col("score").desc(), "instrument_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("chosen", F.col("fit") & (F.col("rank") <= n))
    many = F.count_if("chosen").over(Window.partitionBy(*keys))
    weight = F.when(F.col("chosen"), F.least(F.lit(1.0) / many, F.lit(float(cap)))).otherwise(0.0)
    return rows.withColumn("target_weight", weight).select(*keys, "instrument_id", "current_weight", "target_weight")


def turnover_check(targets: DataFrame, limit: float, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Turnover, cash and whether a plan keeps its limit; a first deployment is exempt (B1)."""
    current = F.coalesce("current_weight", F.lit(0.0))
    sums = targets.groupBy(*keys).agg(F.sum(F.abs(F.col("target_weight") - current)).alias("turnover"), (F.lit(1.0) - F.sum("target_weight")).alias("cash_weight"), (F.sum(current) == 0).alias("initial"))
    return sums.withColumn("within_limit", F.col("initial") | (F.col("turnover") <= limit))


def exposure_of(direction: Column, weight: Column) -> Column:
    """LONG: the weight, FLAT: 0, anything else an error."""
    return F.when(direction == "LONG", weight).when(direction == "FLAT", F.lit(0.0)).otherwise(F.raise_error(F.concat(F.lit("no long-only direction: "), F.coalesce(direction, F.lit("null")))).cast("double"))


def project_allocation(weights: DataFrame, cap: float, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Weights scaled to a sum of 1 at most, capped; the rest is cash."""
    w = Window.partitionBy(*keys)
    total = F.sum("weight").over(w)
    scaled = F.when(total > 1, F.try_divide("weight", total)).otherwise(F.col("weight"))
    rows = weights.withColumn("target_weight", F.least(scaled, F.lit(float(cap))))
    return rows.withColumn("cash_weight", F.lit(1.0) - F.sum("target_weight").over(w))


def industry_cap(weights: DataFrame, cap: float, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Weights scaled down where their industry is above its cap; freed weight stays cash."""
    total = F.sum("weight").over(Window.partitionBy(*keys, "industry"))
    return weights.withColumn("target_weight", F.col("weight") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(cap)), total), F.lit(1.0))))


def rebalance_plan(targets: DataFrame, lot: int = 100, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Orders that lead to the target weights (B8): quantities floored to lots, sells before buys, by id; rows without a price are left out. targets: keys, instrument_id, target_weight, quantity, price, equity."""
    rows = targets.where(is_finite("price") & (F.col("price") > 0))
    wanted = (F.floor(F.col("target_weight") * F.col("equity") / F.col("price") / lot) * lot).cast("long")
    rows = rows.withColumn("change", wanted - F.coalesce("quantity", F.lit(0).cast("long"))).where("change != 0")
    rows = rows.withColumns({"side": F.when(F.col("change") < 0, "SELL").otherwise("BUY"), "order_quantity": F.abs("change")})
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("side") == "SELL", 0).otherwise(1), "instrument_id"))
    return rows.select(*keys, turn.alias("sequence"), "instrument_id", "side", "order_quantity")


def needs_rebalance(weights: DataFrame, tolerance: float, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Whether any weight is off its target by more than the tolerance."""
    off = F.abs(F.coalesce("current_weight", F.lit(0.0)) - F.coalesce("target_weight", F.lit(0.0)))
    return weights.groupBy(*keys).agg(F.max(off).alias("largest_gap"), (F.max(off) > tolerance).alias("rebalance"))


def pursued_targets(sessions: DataFrame, proposals: DataFrame, holdings: DataFrame, tolerance: float, key: str = "portfolio_id") -> DataFrame:
    """What each portfolio works towards on each session (G7): a proposal holds from its session on, until no weight is off by more than the tolerance, or until the next one.

    sessions: key, trade_date. proposals and holdings: key, trade_date, instrument_id, weight; a name that is missing on
    one side weighs 0 there. state: PURSUED (orders are due), REACHED (the session on which the target is met, which ends it) or
    IDLE. Since only the latest proposal can be at work, the state machine is two windows: the latest proposal, and
    whether it was met before within its own stretch.
    """
    made = proposals.select(key, "trade_date").distinct()
    at = asof_backward(sessions.select(key, "trade_date").distinct(), made, [key], "trade_date", []).withColumnRenamed("trade_date_matched", "proposal_date")
    on = at.where("proposal_date is not null")
    target = on.join(proposals.select(key, F.col("trade_date").alias("proposal_date"), "instrument_id", F.col("weight").alias("target")), [key, "proposal_date"]).withColumn("weight", F.lit(0.0))
    held = on.join(holdings.select(key, "trade_date", "instrument_id", "weight"), [key, "trade_date"]).withColumn("target", F.lit(0.0))
    names = target.unionByName(held).groupBy(key, "trade_date", "instrument_id").agg((F.sum("weight") - F.sum("target")).alias("off"))
    gaps = names.groupBy(key, "trade_date").agg(F.max(F.abs("off")).alias("largest_gap"))
    rows = at.join(gaps, [key, "trade_date"], "left").withColumn("met", F.coalesce(F.col("largest_gap") <= tolerance, F.lit(True)))
    before = Window.partitionBy(key, "proposal_date").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("met").over(before), F.lit(False))
    state = F.when(F.col("proposal_date").isNull() | done, "IDLE").when(F.col("met"), "REACHED").otherwise("PURSUED")
    return rows.select(key, "trade_date", "proposal_date", "largest_gap", state.alias("state"))


# --- risk and cost ----------------------------------------------------------------


#: Instruments of a block over a full range and dates of a range: a task multiplies two blocks over one range. Over fewer dates a block has more instruments.
BLOCK_SERIES, RANGE_DATES = 512, 4096
#: Blocks that smaller ones are made for where there are instruments enough, so that all cores have work.
LEAST_BLOCKS = 8
#: Pairs of a strip.
STRIP_PAIRS = 1 << 18


def shrunk_covariance(returns: DataFrame, shrink: float = 0.1, block: int | None = None, span: int = RANGE_DATES) -> DataFrame:
    """Sample covariance of each pair of instruments, off-diagonals shrunk (K1). returns: trade_date, instrument_id, r; a missing cell or return counts as 0.

    Instruments are dealt to blocks of about `block` (by default as many as make BLOCK_SERIES * RANGE_DATES cells of a range), dates to
    ranges of `span`. Each pair of blocks is one matrix product for
    each range, of series centred beforehand, and the products of a pair of instruments are summed over ranges: a task
    holds two blocks of one range whatever the table's size, and no row per pair and date is made. A series is sent once for
    each block. Products leave a task by strips of rows.
    """
    kind, rows = dict(returns.dtypes)["instrument_id"], returns.select("trade_date", "instrument_id", F.coalesce(finite("r"), F.lit(0.0)).alias("r"))
    n_series, n_dates = rows.agg(F.count_distinct("instrument_id"), F.count_distinct("trade_date")).first()
    most = block or max(BLOCK_SERIES, BLOCK_SERIES * RANGE_DATES // max(1, min(n_dates, span)))
    blocks, ranges = max(1, -(-n_series // most)), max(1, -(-n_dates // span))
    if block is None:
        blocks = max(blocks, min(LEAST_BLOCKS, -(-n_series // BLOCK_SERIES)))
    days = rows.select("trade_date").distinct().withColumn("n", F.row_number().over(Window.orderBy("trade_date")) - 1)  # a calendar
    days = days.select("trade_date", F.floor(F.col("n") / span).cast("int").alias("range"), (F.col("n") % span).cast("int").alias("at"))
    parts = rows.join(days, "trade_date").groupBy("instrument_id", "range").agg(F.collect_list(F.struct("at", "r")).alias("cells"), F.sum("r").alias("total"))  # span cells at most
    mean = F.sum("total").over(Window.partitionBy("instrument_id")) / F.lit(float(max(n_dates, 1)))
    # an instrument that has no row in a range is -mean there as well
    series = parts.withColumn("mean", mean)
    every = series.groupBy("instrument_id").agg(F.first("mean").alias("mean"), F.map_from_entries(F.collect_list(F.struct("range", "cells"))).alias("by_range"))
    every = every.select("instrument_id", "mean", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), "by_range").select("instrument_id", "mean", "range", F.coalesce(F.try_element_at("by_range", F.col("range")), F.array().cast(series.schema["cells"].dataType)).alias("cells"))
    dealt = every.withColumn("block", F.pmod(F.xxhash64("instrument_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("instrument_id", "mean", F.transform("cells", lambda c: c["at"]).alias("at"), F.transform("cells", lambda c: c["r"]).alias("r"), "range", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("instrument_id")
        width = min(span, n_dates - span * int(rows["range"].iloc[0]))

        def matrix(part: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(part), width))
            for i, (at, r) in enumerate(zip(part["at"], part["r"])):
                np.add.at(out[i], np.asarray(at, np.int64), np.asarray(r, np.float64))
            return out - part["mean"].to_numpy()[:, None]

        low, high = (rows[rows["block"] == rows[c].iloc[0]] for c in ("low", "high"))
        if low.empty or high.empty:
            return
        same = rows["low"].iloc[0] == rows["high"].iloc[0]
        x = matrix(low)
        y = x if same else matrix(high)
        ids, others = low["instrument_id"].to_numpy(), high["instrument_id"].to_numpy()
        strip = max(1, STRIP_PAIRS // len(y))
        for at in range(0, len(x), strip):
            found = x[at : at + strip] @ y.T
            i, j = (k.ravel() for k in np.indices(found.shape))
            if same:
                upper = j >= i + at
                i, j = i[upper], j[upper]
            a, b = ids[i + at], others[j]
            yield pd.DataFrame({"instrument_x": np.where(a <= b, a, b), "instrument_y": np.where(a <= b, b, a), "product": found[i, j]})

    pairs = dealt.groupBy("low", "high", "range").applyInPandas(product, f"instrument_x {kind}, instrument_y {kind}, product double")
    if ranges > 1:
        pairs = pairs.groupBy("instrument_x", "instrument_y").agg(F.sum("product").alias("product"))
    cov = F.try_divide("product", F.lit(float(n_dates - 1)))
    return pairs.select("instrument_x", "instrument_y", F.when(F.col("instrument_x") == F.col("instrument_y"), cov).otherwise(cov * (1 - shrink)).alias("covariance"))


def pre_trade_cost(size: Column, fixed: float, linear: float, impact: float) -> Column:
    """max(fixed, linear * size) + impact * sqrt(size) (K2)."""
    return F.greatest(F.lit(float(fixed)), size * linear) + F.sqrt(size) * impact


def capacity_weight(adv: Column, participation: float, portfolio_value: Column) -> Column:
    """Largest weight that can be traded at a share of the average amount (K3)."""
    return F.try_divide(adv * participation, portfolio_value)


def cost_estimates(liquidity: DataFrame, model: str, commission_bps: float, minimum_cents: int, impact_bps: float = 0.0, participation: float = 0.1) -> DataFrame:
    """Cost terms of each name as shares of the portfolio (K3): sqrt_impact puts the impact on the root of the size, linear_impact on the size, any other model has none.

    liquidity: signal_date, instrument_id, amount (a day's average), equity_cents. Out come
    fixed, linear, square_root and capacity, the largest weight that trades at
    the participation; without equity fixed and capacity are 0.
    """
    return cost_estimates_by_model(liquidity, [model], commission_bps, minimum_cents, impact_bps, participation).drop("model")


def cost_estimates_by_model(liquidity: DataFrame, models: Sequence[str], commission_bps: float, minimum_cents: int, impact_bps: float = 0.0, participation: float = 0.1) -> DataFrame:
    """The cost terms of each name under each of several models, of one reading of the names (K3)."""
    if not 0 < participation <= 1 or impact_bps < 0:
        raise ValueError("participation is above 0 and at most 1, impact is not negative")
    impact = impact_bps / 10_000
    funded = F.col("equity_cents") > 0
    terms = lambda m: F.struct(F.lit(m).alias("model"), F.lit(commission_bps / 10_000 + (impact if m == "linear_impact" else 0.0)).alias("linear"), F.lit(impact if m == "sqrt_impact" else 0.0).alias("square_root"))
    rows = liquidity.select("signal_date", "instrument_id", "amount", "equity_cents", F.inline(F.array(*map(terms, models))))
    return rows.select(
        "model", "signal_date", "instrument_id", F.when(funded, F.lit(float(minimum_cents)) / F.col("equity_cents")).otherwise(0.0).alias("fixed"),
        "linear", "square_root",
        F.when(funded, F.greatest(F.lit(0.0), F.col("amount") * participation / (F.col("equity_cents") / 100))).otherwise(0.0).alias("capacity"),
    )


def realized_cost(gross: Column, side: Column, commission_bps: float, tax_bps: float) -> Column:
    """Commission, and tax on sells, in whole cents, each rounded half to even (K4)."""
    part = lambda bps: F.bround(gross * bps / 10_000, 0).cast("long")
    return part(commission_bps) + F.when(side == "SELL", part(tax_bps)).otherwise(F.lit(0).cast("long"))



def strategy_universe(instruments: DataFrame, sessions: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every instrument on every session, out only while under a risk warning or suspended (U4)."""
    rows = grid(instruments.select("instrument_id"), sessions.select("signal_date")).join(statuses, ["signal_date", "instrument_id"], "left")
    reasons = _reasons([(F.col("is_risk_warning"), "RISK_WARNING"), (F.col("is_suspended"), "SUSPENDED")])
    return rows.withColumn("reasons", reasons).select("signal_date", "instrument_id", (F.size("reasons") == 0).alias("eligible"), "reasons")


def dual_ma_strategy(bars: DataFrame, sessions: DataFrame, short: int, long: int) -> DataFrame:
    """ENTER, EXIT or HOLD by two moving averages over the last sessions without a gap.

    sessions: trade_date, session_ordinal. A state lasts over rows whose window has a gap,
    and a first FLAT does nothing.
    """
    w = by("instrument_id", "trade_date")
    rows = bars.join(sessions, "trade_date")
    whole = F.col("session_ordinal") - F.lag("session_ordinal", long - 1).over(w) == long - 1
    rows = rows.withColumns({"short_ma": rolling_mean("close", w, short), "long_ma": rolling_mean("close", w, long), "whole": F.coalesce(whole, F.lit(False))})
    ok = F.col("whole") & F.col("short_ma").isNotNull() & F.col("long_ma").isNotNull()
    rows = rows.withColumn("direction", F.when(ok, F.when(F.col("short_ma") > F.col("long_ma"), "LONG").otherwise("FLAT")))
    before = F.last("direction", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit("FLAT")))
    act = F.when((F.col("direction") == "LONG") & (F.col("before") == "FLAT"), "ENTER").when((F.col("direction") == "FLAT") & (F.col("before") == "LONG"), "EXIT").otherwise("HOLD")
    return rows.select("instrument_id", F.col("trade_date").alias("signal_date"), "direction", act.alias("action"), F.when(F.col("direction").isNull(), "INSUFFICIENT_CONTIGUOUS_WINDOW").alias("invalid_reason"))
