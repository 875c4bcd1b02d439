"""The factor library (F1-F17): each factor is a DataFrame of the same seven columns.

Market factors read a session-complete panel (instrument_id, trade_date, log_return,
available_at). A value is valid if the instrument has had `rows` rows, every
availability among them is known and the value is finite; its available_at is then
the latest of theirs (F3).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.numeric import finite, first_reason, is_finite
from panelspark.operators.relational import asof_backward, latest
from panelspark.operators.windows import by, path_drawdown, rolling_mean, rolling_std, rolling_sum, weighted_sum

YEAR = 252
COLUMNS = ("signal_date", "instrument_id", "factor_id", "value", "available_at", "is_valid", "invalid_reason")


@dataclass(frozen=True)
class Factor:
    """What a factor is called, reads, needs and computes. direction: -1 where less is better. auxiliary: no signal of its own."""

    factor_id: str
    compute: Callable[[DataFrame], DataFrame]
    source: str = "panel"
    direction: int = 1
    requires: tuple[str, ...] = ()
    auxiliary: bool = False


def _shaped(df: DataFrame, factor_id: Column | str, value: Column, reason: Column, available_at: Column) -> DataFrame:
    rows = df.withColumns({"__value": value, "__at": available_at})
    rows = rows.withColumn("__reason", reason)
    ok = F.col("__reason").isNull()
    return rows.select(
        F.col("trade_date").alias("signal_date"), "instrument_id", (F.lit(factor_id) if isinstance(factor_id, str) else factor_id).alias("factor_id"), F.when(ok, F.col("__value")).alias("value"),
        F.when(ok, F.col("__at")).alias("available_at"), ok.alias("is_valid"), F.col("__reason").alias("invalid_reason"),
    )


def market_factor(factor_id: str, value: Callable[[WindowSpec], Column], rows: int) -> Callable[[DataFrame], DataFrame]:
    """A factor over the last `rows` rows of each instrument."""

    def compute(panel: DataFrame) -> DataFrame:
        w = by("instrument_id", "trade_date")
        frame = w.rowsBetween(-(rows - 1), 0)
        reason = first_reason(
            (F.row_number().over(w) < rows, "INSUFFICIENT_HISTORY"),
            (F.count("available_at").over(frame) < rows, "AVAILABILITY_UNKNOWN"),
            (~is_finite("__value"), "NONFINITE_VALUE"),
        )
        return _shaped(panel, factor_id, value(w), reason, F.max("available_at").over(frame))

    return compute


def market_factors(factors: dict[str, tuple[Callable[[WindowSpec], Column], int]]) -> Callable[[DataFrame], DataFrame]:
    """Several market factors (id: value, rows) in long form: their frames share one window, so the panel is dealt and sorted once for all."""

    def compute(panel: DataFrame) -> DataFrame:
        w = by("instrument_id", "trade_date")
        made, each = {"__row": F.row_number().over(w)}, []
        for i, (factor_id, (value, rows)) in enumerate(factors.items()):
            frame = w.rowsBetween(-(rows - 1), 0)
            made |= {f"__v{i}": value(w), f"__n{i}": F.count("available_at").over(frame), f"__a{i}": F.max("available_at").over(frame)}
            each.append(F.struct(F.lit(factor_id).alias("factor_id"), F.lit(rows).alias("rows"), F.col(f"__v{i}").alias("v"), F.col(f"__n{i}").alias("known"), F.col(f"__a{i}").alias("at")))
        cells = panel.withColumns(made).select("trade_date", "instrument_id", "__row", F.inline(F.array(*each)))
        reason = first_reason((F.col("__row") < F.col("rows"), "INSUFFICIENT_HISTORY"), (F.col("known") < F.col("rows"), "AVAILABILITY_UNKNOWN"), (~is_finite("__value"), "NONFINITE_VALUE"))
        return _shaped(cells, F.col("factor_id"), F.col("v"), reason, F.col("at"))

    return compute


def period_return(n: int) -> Callable[[WindowSpec], Column]:
    """expm1 of the sum of the last n log returns (F1)."""
    return lambda w: F.expm1(rolling_sum("log_return", w, n))


def skipped_momentum(n: int, skip: int) -> Callable[[WindowSpec], Column]:
    """The return over n periods that ended `skip` periods ago (F2)."""

    def value(w: WindowSpec) -> Column:
        r, frame = finite("log_return"), w.rowsBetween(-(n - 1), -skip)
        return F.expm1(F.when(F.count(r).over(frame) == n - skip, F.sum(r).over(frame)))

    return value


def trend_weights(n: int) -> list[float]:
    """Weights of n - 1 returns that give the least-squares slope of their cumulative path over n points."""
    return [i * (n - i) / 2 / (n * (n * n - 1) / 12) for i in range(1, n)]


def trend(n: int) -> Callable[[WindowSpec], Column]:
    return lambda w: weighted_sum("log_return", w, trend_weights(n))


def volatility(n: int, year: int = YEAR) -> Callable[[WindowSpec], Column]:
    return lambda w: rolling_std("log_return", w, n) * F.lit(float(year) ** 0.5)


def downside_volatility(n: int, year: int = YEAR) -> Callable[[WindowSpec], Column]:
    """Root mean square of the negative parts."""

    def value(w: WindowSpec) -> Column:
        loss = F.least(finite("log_return"), F.lit(0.0))
        return F.sqrt(rolling_mean(F.when(is_finite("log_return"), loss * loss), w, n)) * F.lit(float(year) ** 0.5)

    return value


def drawdown(n: int) -> Callable[[WindowSpec], Column]:
    return lambda w: path_drawdown("log_return", w, n - 1)


def observed_mean(factor_id: str, column: str, n: int) -> Callable[[DataFrame], DataFrame]:
    """Mean of a column over the instrument's last n observed rows, all finite, not negative and known on the day."""

    def compute(rows: DataFrame) -> DataFrame:
        w = by("instrument_id", "trade_date")
        frame = w.rowsBetween(-(n - 1), 0)
        good = F.when(is_finite(column) & (F.col(column) >= 0), F.col(column))
        reason = first_reason(
            (F.row_number().over(w) < n, "INSUFFICIENT_HISTORY"),
            (F.count("available_at").over(frame) < n, "AVAILABILITY_UNKNOWN"),
            (F.max("available_at").over(frame) > known_until("trade_date"), "NOT_KNOWN_ON_DAY"),
            (F.count(good).over(frame) < n, "INVALID_INPUT"),
        )
        return _shaped(rows, factor_id, F.avg(good).over(frame), reason, F.max("available_at").over(frame))

    return compute


def known_until(day: str) -> Column:
    """The end of a day, as a timestamp."""
    return F.date_add(F.to_date(day), 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")


def fundamental(factor_id: str, column: str, value: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A factor of one column of the same day, known on it."""

    def compute(rows: DataFrame) -> DataFrame:
        x = F.col(column).cast("double")
        reason = first_reason(
            (F.col("available_at").isNull(), "AVAILABILITY_UNKNOWN"),
            (F.col("available_at") > known_until("trade_date"), "NOT_KNOWN_ON_DAY"),
            (x.isNull(), "MISSING_VALUE"),
            (~is_finite(x), "NONFINITE_VALUE"),
            (~valid(x), "INVALID_DENOMINATOR"),
        )
        return _shaped(rows, factor_id, F.when(is_finite(x) & valid(x), value(x)), reason, F.col("available_at"))

    return compute


def inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def transitions(records: DataFrame) -> DataFrame:
    """Financial records that moved the known report period forward.

    Of each (instrument, available_at, period) the last revision; then only records
    whose period is the latest known by then.
    """
    rows = latest(records, ["instrument_id", "available_at", "report_period"], ["revision"])
    w = by("instrument_id", "available_at")
    # rows of one available_at are peers: the default frame of an ordered window holds them all
    at_once = rows.withColumn("__latest", F.max("report_period").over(w))
    kept = at_once.where(F.col("report_period") == F.col("__latest")).drop("__latest")
    return latest(kept, ["instrument_id", "available_at"], ["report_period"])


def financial(factor_id: str, column: str, signals: DataFrame, most_days: int = 190, positive: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A metric as of the latest transition known at the end of the day, valid if finite and 0 to most_days old (F13). signals: instrument_id, trade_date."""

    def compute(records: DataFrame) -> DataFrame:
        known = transitions(records).select("instrument_id", F.col("available_at").alias("signal_at"), "report_period", column)
        asked = signals.select("instrument_id", "trade_date", known_until("trade_date").alias("signal_at"))
        met = asof_backward(asked, known, ["instrument_id"], "signal_at", ["report_period", column])
        age = F.datediff("trade_date", "report_period")
        x = F.col(column).cast("double")
        reason = first_reason(
            (F.col("signal_at_matched").isNull(), "NO_RECORD"),
            (x.isNull(), "MISSING_VALUE"),
            (~is_finite(x), "NONFINITE_VALUE"),
            ((age < 0) | (age > most_days), "STALE_RECORD"),
            ((x < 0) if positive else F.lit(False), "NEGATIVE_VALUE"),
        )
        return _shaped(met, factor_id, x, reason, F.col("signal_at_matched"))

    return compute


#: A financial factor's column in the records; a leverage is never negative and ranks downwards.
FINANCIALS = {"roe": "roe", "roa": "roa", "revenue_growth": "tr_yoy", "profit_growth": "netprofit_yoy", "gross_margin": "gross_margin", "cash_quality": "ocf_to_opincome", "leverage": "debt_to_assets"}


def financial_factors(signals: DataFrame) -> list[Factor]:
    """The financial metrics as of the cells asked for (F13), from the source `financials`. signals: instrument_id, trade_date."""
    return [Factor(f, financial(f, c, signals, positive=f == "leverage"), "financials", -1 if f == "leverage" else 1) for f, c in FINANCIALS.items()]


def standard_factors(scale: int = 1) -> list[Factor]:
    """The market, turnover and valuation factors. scale divides the look-backs, for panels of longer periods."""
    n = lambda days: max(2, days // scale)
    m = lambda name, value, rows, **k: Factor(name, market_factor(name, value, rows), **k)
    out = [m(f"return_{d}d", period_return(n(d)), n(d) + 1) for d in (20, 60, 120)]
    out += [
        m("momentum_120_20", skipped_momentum(n(120), n(20)), n(120) + 1),
        m("trend_120d", trend(n(120)), n(120)),
        m("volatility_60d", volatility(n(60)), n(60) + 1, direction=-1),
        m("downside_volatility_60d", downside_volatility(n(60)), n(60) + 1, direction=-1),
        m("max_drawdown_120d", drawdown(n(120)), n(120), direction=-1),
        Factor("turnover_20d", observed_mean("turnover_20d", "turnover_rate_free_float", n(20)), "turnover", -1),
        Factor("avg_amount_20d", observed_mean("avg_amount_20d", "amount", n(20)), "bars", auxiliary=True),
    ]
    yields = {"earnings_yield_ttm": "pe_ttm", "book_to_price_mrq": "pb", "sales_yield": "ps_ttm"}
    out += [Factor(f, fundamental(f, c, inverse, lambda x: x != 0), "basics") for f, c in yields.items()]
    out.append(Factor("dividend_yield", fundamental("dividend_yield", "dividend_yield_ttm", lambda x: x, lambda x: x >= 0), "basics"))
    out.append(Factor("log_total_market_cap", fundamental("log_total_market_cap", "total_market_value", F.ln, lambda x: x > 0), "basics", -1))
    return out


@dataclass
class Registry:
    """Factors by id (F14): the order of a plan, and what it can't compute."""

    factors: dict[str, Factor] = field(default_factory=dict)

    def register(self, *factors: Factor) -> Registry:
        for f in factors:
            if f.factor_id in self.factors:
                raise ValueError(f"factor {f.factor_id} is registered twice")
            self.factors[f.factor_id] = f
        return self

    def plan(self, wanted: Sequence[str]) -> list[Factor]:
        """The wanted factors and what they require, each after its requirements."""
        order: list[Factor] = []
        done: set[str] = set()

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError("factors require each other: " + " -> ".join([*above, name]))
            if name not in self.factors:
                raise KeyError(f"no factor is called {name}")
            if name not in done:
                for r in self.factors[name].requires:
                    visit(r, (*above, name))
                done.add(name)
                order.append(self.factors[name])

        for name in wanted:
            visit(name, ())
        return order

    def signals(self, wanted: Sequence[str]) -> list[Factor]:
        """The wanted factors, none of which may be auxiliary."""
        bad = [n for n in wanted if self.factors[n].auxiliary]
        if bad:
            raise ValueError("auxiliary factors are no signals: " + ", ".join(bad))
        return [self.factors[n] for n in wanted]


def compute_factors(registry: Registry, wanted: Sequence[str], sources: dict[str, DataFrame]) -> DataFrame:
    """All wanted factors in long form (F15). Sources are dealt by instrument, so that factors of one source share a shuffle (F16)."""
    plan = registry.plan(wanted)
    missing = sorted({f.source for f in plan} - set(sources))
    if missing:
        raise ValueError("sources are missing: " + ", ".join(missing))
    dealt = {name: df.repartition("instrument_id") for name, df in sources.items() if name in {f.source for f in plan}}
    return reduce(DataFrame.unionByName, (f.compute(dealt[f.source]).select(*COLUMNS) for f in plan if f.factor_id in set(wanted)))


def contract_violations(factors: DataFrame) -> DataFrame:
    """Counts of rows that break the contract: valid without a finite value or availability, invalid with a value or without a reason, repeated keys."""
    bad = lambda c: F.count_if(c)
    keys = factors.groupBy("signal_date", "instrument_id", "factor_id").count().where("count > 1").agg(F.count("*").alias("n_repeated_keys"))
    counts = factors.agg(
        bad(F.col("is_valid") & ~is_finite("value")).alias("n_valid_without_value"), bad(F.col("is_valid") & F.col("available_at").isNull()).alias("n_valid_without_time"),
        bad(~F.col("is_valid") & F.col("value").isNotNull()).alias("n_invalid_with_value"), bad(~F.col("is_valid") & F.col("invalid_reason").isNull()).alias("n_invalid_without_reason"),
    )
    return counts.crossJoin(F.broadcast(keys))  # one row each

