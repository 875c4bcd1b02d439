from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from math import erfc, sqrt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import bucket, first_reason, is_finite
from panelspark.operators import backtest, decisions, factors, inference, labels, performance, prices, quality, relational, rules, study, transforms
from panelspark.operators import windows as win

D0 = date(2024, 1, 1)
NAN, INF = float("nan"), float("inf")


def day(i: int) -> date:
    return D0 + timedelta(days=i)


def test_finite_rejects_null_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (INF,), (-INF,), (0.0,)], "v double")
    assert [r.ok for r in df.select(is_finite("v").alias("ok")).collect()] == [True, False, False, False, False, True]
    assert df.limit(0).select(first_reason((is_finite("v"), "A"))).count() == 0


def test_buckets_are_not_ntiles(spark):
    for n, q, want in ((10, 4, [3, 2, 3, 2]), (13, 5, [3, 3, 2, 3, 2]), (3, 5, [1, 1, 0, 1, 0])):
        rows = spark.range(n).select(F.lit(1).alias("k"), "id").withColumn("b", bucket(q, ["k"], ["id"])).groupBy("b").count().collect()
        sizes = {r.b: r["count"] for r in rows}
        assert [sizes.get(i, 0) for i in range(1, q + 1)] == want


def test_ic_literals(spark):
    def ic(x, y):
        f = spark.createDataFrame([(D0, i, "f", float(v), True) for i, v in enumerate(x)], "signal_date date, instrument_id long, factor_id string, value double, is_valid boolean")
        r = spark.createDataFrame([(D0, i, float(v)) for i, v in enumerate(y)], "signal_date date, instrument_id long, future_return double")
        return study.daily_ic(f, r).first()

    row = ic([1, 2, 3, 100], [1, 2, 4, 5])
    assert row.ic == pytest.approx(0.7413718364364857) and row.rank_ic == pytest.approx(1.0)
    assert ic([1, 1, 2, 3], [1, 2, 3, 4]).rank_ic == pytest.approx(0.9486832980505138)
    assert ic([1, 1, 1, 1], [1, 2, 3, 4]).invalid_reason == "ZERO_FACTOR_VARIANCE"
    assert ic([1, 2, 3, 4], [2, 2, 2, 2]).invalid_reason == "ZERO_RETURN_VARIANCE"
    assert ic([1, NAN, INF, 4], [1, 2, 3, 4]).invalid_reason == "INSUFFICIENT_CROSS_SECTION"
    assert ic([1, 2, 3, 4], [1, NAN, INF, 4]).invalid_reason == "INSUFFICIENT_FORWARD_PAIRS"


def test_ic_summary_literals(spark):
    ic = spark.createDataFrame([(day(i), "f", v) for i, v in enumerate([-1.0, -0.5, 0.0, 0.5, 1.0, None, -0.25])], "signal_date date, factor_id string, rank_ic double")
    r = study.ic_summary(ic).first()
    assert r["mean"] == pytest.approx(-1 / 24) and r["std"] == pytest.approx(0.7144345083117604) and r.positive_rate == pytest.approx(2 / 6)
    assert [r.p05, r.p25, r.p50, r.p75, r.p95] == pytest.approx([-0.875, -0.4375, -0.125, 0.375, 0.875])
    assert (r.longest_positive, r.longest_negative) == (2, 2)


def hac(values, horizon):
    n = sum(v is not None for v in values)
    if n < 2:
        return None
    mean = sum(v for v in values if v is not None) / n
    e = [None if v is None else v - mean for v in values]
    lag = min(horizon - 1, len(values) - 1)
    total = 0.0
    for k in range(lag + 1):
        g = sum(e[i] * e[i - k] for i in range(k, len(e)) if e[i] is not None and e[i - k] is not None)
        total += g if k == 0 else 2 * (1 - k / (lag + 1)) * g
    return mean, math.sqrt(total / n / n), lag


@pytest.mark.parametrize("values, horizon, se", [([0.01, 0.02, 0.03, 0.04], 3, 0.005951190357119042), ([2, None, 0], 2, 0.7071067811865476), ([None, 2, None, 0, None], 3, 0.5773502691896257)])
def test_hac_literals(spark, values, horizon, se):
    df = spark.createDataFrame([("k", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    r = inference.hac_mean(df, "v", ["k"], "i", horizon).first()
    mean, want, lag = hac(values, horizon)
    assert r.se == pytest.approx(se) and r.se == pytest.approx(want) and r["mean"] == pytest.approx(mean) and r.lag == lag
    assert r.p_value == pytest.approx(erfc(abs(mean / se) / sqrt(2)))


def test_hac_degenerate(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("b", 0, None), ("b", 1, 2.0), ("b", 2, None), ("c", 0, 1.0), ("c", 1, 1.0)], "k string, i int, v double")
    got = {r.k: (r.invalid_reason, r.p_value) for r in inference.hac_mean(df, "v", ["k"], "i", 5).collect()}
    assert got == {"a": ("NO_VALID_OBSERVATIONS", None), "b": ("INSUFFICIENT_OBSERVATIONS", None), "c": ("NONPOSITIVE_LONG_RUN_VARIANCE", None)}


def test_multiple_testing_with_ties(spark):
    p = [0.01, 0.04, 0.04, 0.03, 0.5, None, 1.0]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(p)], "i int, family string, p double")
    got = {r.i: r for r in inference.adjusted_p_values(df, "family", "p", "i").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    best, want = 1.0, {}
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        best = min(best, v * len(known) / rank)
        want[i] = best
    assert all(got[i].bh_fdr == pytest.approx(w) and got[i].bonferroni == pytest.approx(min(1, p[i] * 6)) for i, w in want.items())
    assert got[5].bh_fdr is None and len(got) == 7


def test_multiple_testing_by_ranges(spark):
    rng = random.Random(7)
    rows = [(i, f, rng.choice([None, math.nan, round(rng.random() ** 3, 2)])) for i in range(900) for f in ("f", "g")]
    df = spark.createDataFrame(rows, "i int, family string, p double")
    out = inference.adjusted_p_values(df, "family", "p", "i", 40)
    got = {(r.family, r.i): (r.bonferroni, r.bh_fdr) for r in out.collect()}
    assert len(got) == len(rows)
    for f in ("f", "g"):
        known, best = sorted((p, i) for i, g, p in rows if g == f and p is not None and p == p), 1.0
        for rank in range(len(known), 0, -1):
            p, i = known[rank - 1]
            best = min(best, p * len(known) / rank)
            assert got[f, i] == (min(1.0, p * len(known)), best)
    # a frame without an end on its far side is read anew for every row
    plan = inference.adjusted_p_values(df, "family", "p", "i")._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "currentrow$()" in plan


def test_winsorize_and_zscore_reasons(spark):
    rows = [("a", 1.0, True, None), ("a", 2.0, True, None), ("a", 100.0, True, None), ("a", 3.0, True, None), ("a", NAN, True, None), ("a", None, True, None), ("a", 9.0, False, "OWN"), ("b", 1.0, True, None), ("b", 2.0, True, None), ("c", 5.0, True, None), ("c", 5.0, True, None), ("c", 5.0, True, None)]
    df = spark.createDataFrame(rows, "g string, v double, is_valid boolean, invalid_reason string")
    got = [(r.g, r.v, r.winsorized, r.invalid_reason) for r in transforms.winsorize_mad(df, "v", ["g"]).collect()]
    # the valid rows of a are 1, 2, 3, 100: median 2.5, MAD 1
    assert ("a", 100.0, 5.5, None) in got and ("a", 1.0, 1.0, None) in got and ("b", 1.0, None, "INSUFFICIENT_CROSS_SECTION") in got and ("c", 5.0, 5.0, None) in got
    assert {r[3] for r in got if r[0] == "a" and r[2] is None} == {"MISSING_VALUE", "NONFINITE_VALUE", "OWN"}
    z = {(r.g, r.invalid_reason) for r in transforms.zscore(df, "v", ["g"]).where("not is_valid").collect()}
    assert ("c", "ZERO_VARIANCE") in z
    big = spark.createDataFrame([("a", 1e308), ("a", -1e308), ("a", 0.0)], "g string, v double")
    assert [round(r.zscore, 6) for r in transforms.zscore(big, "v", ["g"]).orderBy("v").collect()] == [-1.224745, 0.0, 1.224745]
    assert transforms.zscore(df.limit(0), "v", ["g"]).count() == 0


def test_neutralization_reasons_and_residuals(spark):
    rng = random.Random(1)
    rows = [("d", i, f"n{i % 3}", rng.random(), math.exp(rng.random() * 4)) for i in range(20)] + [("d", 90, "alone", 1.0, 2.0), ("d", 91, " ", 1.0, 2.0), ("d", 92, "n1", 1.0, -1.0), ("d", 93, "n1", 1.0, None), ("d", 94, "n1", 1.0, INF)]
    df = spark.createDataFrame(rows, "g string, i int, industry string, v double, cap double")
    reasons = {r.i: r.invalid_reason for r in transforms.neutralize_industry_market_cap(df, "v", ["g"], "industry", "cap").collect() if r.i >= 90}
    assert reasons == {90: "SINGLE_MEMBER_INDUSTRY", 91: "MISSING_INDUSTRY", 92: "NONPOSITIVE_MARKET_CAP", 93: "MISSING_MARKET_CAP", 94: "NONFINITE_MARKET_CAP"}
    fit = transforms.neutralize_market_cap(df.where("i < 20"), "v", ["g"], "cap").collect()
    x = [math.log(r.cap) for r in fit]
    assert sum(r.neutralized for r in fit) == pytest.approx(0, abs=1e-9) and sum(a * r.neutralized for a, r in zip(x, fit)) == pytest.approx(0, abs=1e-9)


def test_forward_label_literals(spark):
    bars = spark.createDataFrame([(day(i), "A", o, c) for i, (o, c) in enumerate([(9.0, 9.5), (10.0, 11.0), (11.0, 12.0), (12.0, 13.0)])], "trade_date date, instrument_id string, open double, close double")
    signals = spark.createDataFrame([(day(0), "A"), (day(3), "A"), (day(0), "B")], "signal_date date, instrument_id string")
    got = {(r.signal_date, r.instrument_id, r.horizon): (r.future_return, r.invalid_reason) for r in labels.forward_returns(signals, bars.select("trade_date"), bars, (1, 2)).collect()}
    assert got[day(0), "A", 1][0] == pytest.approx(0.1) and got[day(0), "A", 2][0] == pytest.approx(0.2)
    assert got[day(3), "A", 1] == (None, "INCOMPLETE_FORWARD_WINDOW") and got[day(0), "B", 1] == (None, "MISSING_ENTRY_PRICE")


def test_monotonicity_turnover_and_cost_literals(spark):
    rows = [(day(t), i, "f", float(i if t == 0 else 30 - i), True) for t in (0, 1) for i in range(30)]
    f = spark.createDataFrame(rows, "signal_date date, instrument_id long, factor_id string, value double, is_valid boolean")
    r = spark.createDataFrame([(day(t), i, 0.01 * (i if t == 0 else 30 - i)) for t in (0, 1) for i in range(30)], "signal_date date, instrument_id long, future_return double")
    q = study.quantile_returns(f, r)
    m = study.monotonicity(q).orderBy("signal_date").collect()
    assert m[0].terminal_spread == pytest.approx(0.24) and m[0].rank_correlation == pytest.approx(1) and m[0].inversions == 0
    t = {x.signal_date: x for x in study.quantile_turnover(f).collect()}
    assert t[day(1)].turnover == pytest.approx(2.0) and t[day(1)].rank_autocorrelation == pytest.approx(-1.0) and t[day(0)].invalid_reason == "NO_PREVIOUS_SIGNAL_DATE"
    c = {x.cost_bps: x for x in study.cost_scenarios(study.long_short(q), study.quantile_turnover(f), (5,)).collect()}
    assert c[5.0].gross == pytest.approx(0.24) and c[5.0].net == pytest.approx(0.24 - 2 * 5 / 10_000)


def test_empty_factors(spark):
    f = spark.createDataFrame([], "signal_date date, instrument_id long, factor_id string, value double, is_valid boolean")
    r = spark.createDataFrame([], "signal_date date, instrument_id long, future_return double")
    for df in (study.daily_ic(f, r), study.quantile_returns(f, r), study.quantile_turnover(f), study.factor_correlations(f), study.ic_summary(study.daily_ic(f, r))):
        assert df.count() == 0


def test_asof_keeps_null_payloads_and_null_keys(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 5, "c"), (None, 5, "d"), (1, None, "e")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, None), (1, 3, 30), (2, 9, 90), (None, 1, 1)], "k int, t int, v int")
    exact = {r.x: (r.t_matched, r.v) for r in relational.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert exact == {"a": (5, None), "b": (5, None), "c": (None, None), "d": (None, None), "e": (None, None)}
    strict = {r.x: (r.t_matched, r.v) for r in relational.asof_backward(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert strict["a"] == (3, 30) and strict["b"] == (5, None)


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="same k"):
        relational.require_unique(df, ["k"])
    with pytest.raises(ValueError, match="missing"):
        relational.require_columns(df, k="int", z="string")
    assert relational.require_columns(df, k="int", v="") is df
    assert relational.content_hash(df).collect() == relational.content_hash(df.orderBy("v", ascending=False)).collect()


def test_windows_enforce_minimum_counts(spark):
    values = [0.1, None, 0.2, 0.3, NAN, 0.1, -0.5, 0.2]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, r double")
    w = Window.partitionBy("k").orderBy("t")
    rows = df.select("t", win.rolling_sum("r", w, 2).alias("s"), win.path_drawdown("r", w, 3).alias("d"), win.running_sum("r", w).alias("c"), win.rolling_mean_of_valid("r", w, 4, 3).alias("m")).orderBy("t").collect()
    assert [r.s is not None for r in rows] == [False, False, False, True, False, False, True, True]
    assert rows[7].d == pytest.approx(1 - math.exp(-0.5)) and rows[7].c == pytest.approx(0.4) and rows[3].m == pytest.approx(0.2)


def test_trend_is_the_slope_of_the_path(spark):
    rng = random.Random(4)
    r = [rng.gauss(0, 0.02) for _ in range(11)]
    path = [0.0]
    for x in r:
        path.append(path[-1] + x)
    n = 12
    mean = sum(path) / n
    slope = sum((i - (n - 1) / 2) * (p - mean) for i, p in enumerate(path)) / sum((i - (n - 1) / 2) ** 2 for i in range(n))
    assert sum(a * b for a, b in zip(factors.trend_weights(12), r)) == pytest.approx(slope)


def test_registry_orders_and_refuses(spark):
    f = lambda name, *need, aux=False: factors.Factor(name, lambda df: df, requires=need, auxiliary=aux)
    reg = factors.Registry().register(f("a", "b"), f("b", "c"), f("c"), f("x", "y"), f("y", "x"), f("aux", aux=True))
    assert [p.factor_id for p in reg.plan(["a"])] == ["c", "b", "a"]
    with pytest.raises(ValueError, match="require each other"):
        reg.plan(["x"])
    with pytest.raises(ValueError, match="no signals"):
        reg.signals(["a", "aux"])
    with pytest.raises(ValueError, match="twice"):
        reg.register(f("a"))


def test_standard_factors_meet_their_contract(spark):
    panel = spark.createDataFrame([(i, day(t), 0.01 * ((i + t) % 5 - 2), datetime(2024, 1, 1)) for i in range(4) for t in range(30)], "instrument_id long, trade_date date, log_return double, available_at timestamp_ntz")
    basics = panel.select("instrument_id", "trade_date", "available_at", *[F.lit(v).alias(c) for c, v in (("pe_ttm", 10.0), ("pb", 0.0), ("ps_ttm", -2.0), ("dividend_yield_ttm", -1.0), ("total_market_value", 5.0))])
    sources = {"panel": panel, "basics": basics, "turnover": panel.withColumn("turnover_rate_free_float", F.lit(0.5)), "bars": panel.withColumn("amount", F.lit(7.0))}
    reg = factors.Registry().register(*factors.standard_factors(10))
    out = factors.compute_factors(reg, list(reg.factors), sources)
    assert out.columns == list(factors.COLUMNS) and set(factors.contract_violations(out).first()) == {0}
    valid = {r.factor_id: r["count"] for r in out.where("is_valid").groupBy("factor_id").count().collect()}
    assert "book_to_price_mrq" not in valid and "dividend_yield" not in valid and valid["sales_yield"] == 120 and valid["turnover_20d"] == 4 * 29


def test_adjustment_and_lookback(spark):
    bars = spark.createDataFrame([("A", day(i), 10.0, 10.0, 10.0, 10.0 + i, 9.0 + i, v, v) for i, v in enumerate([1.0, 1.0, 0.0, 1.0])], "instrument_id string, trade_date date, open double, high double, low double, close double, preclose double, volume double, amount double")
    f = spark.createDataFrame([("A", day(0), 1.0), ("A", day(3), 2.0)], "instrument_id string, trade_date date, adjustment_factor double")
    got = {r.trade_date: r for r in prices.adjust_forward(bars, f).collect()}
    assert set(got) == {day(0), day(1), day(3)}
    assert got[day(0)].adj_close == 5.0 and got[day(3)].adj_close == 13.0 and got[day(3)].adj_preclose == 6.0 and got[day(0)].adj_preclose == 4.5
    bad = prices.adjust_forward(bars, f.withColumn("adjustment_factor", F.lit(0.0))).collect()
    assert not any(r.is_valid for r in bad)


def test_drawdown_episodes(spark):
    nav = spark.createDataFrame([(1, day(i), e, e) for i, e in enumerate([10000, 11000, 9900, 11000, 10000])], "portfolio_id int, trade_date date, equity long, benchmark long")
    r = performance.daily_returns(nav)
    assert [round(x.drawdown, 9) for x in r.orderBy("trade_date").collect()] == [0, 0, -0.1, 0, round(10 / 11 - 1, 9)]
    e = performance.drawdown_episodes(r).orderBy("peak_date").collect()
    assert [(x.peak_date, x.trough_date, x.recovery_date, x.n_sessions) for x in e] == [(day(1), day(2), day(3), 1), (day(3), day(4), None, 1)]
    flat = performance.headline(performance.daily_returns(nav.withColumn("equity", F.lit(5).cast("long")))).first()
    assert flat.sharpe is None and flat.sharpe_reason == "ZERO_VOLATILITY" and flat.sortino_reason == "ZERO_DOWNSIDE_DEVIATION"
    one = performance.headline(performance.daily_returns(nav.limit(1))).first()
    assert one.beta_reason == "INSUFFICIENT_OBSERVATIONS" and performance.headline(performance.daily_returns(nav.limit(0))).count() == 0


def test_dual_ma_literals(spark):
    bars = spark.createDataFrame([("A", day(i), float(c)) for i, c in enumerate([3, 2, 1, 2, 4, 5])], "instrument_id string, trade_date date, close double")
    rows = decisions.dual_ma(bars, 2, 3).orderBy("signal_date").collect()
    assert [r.direction for r in rows] == [None, None, "FLAT", "FLAT", "LONG", "LONG"] and [r.changed for r in rows] == [False] * 4 + [True, False]


def test_direction_mapper_refuses_short(spark):
    df = spark.createDataFrame([("LONG",), ("FLAT",)], "d string")
    assert [r[0] for r in df.select(decisions.exposure_of(F.col("d"), F.lit(0.3))).collect()] == [0.3, 0.0]
    with pytest.raises(Exception, match="long-only"):
        spark.createDataFrame([("SHORT",)], "d string").select(decisions.exposure_of(F.col("d"), F.lit(0.3))).collect()


def test_quality_rules(spark):
    df = spark.createDataFrame([("000001.SZ", D0), ("bad", D0), (None, None)], "id string, d date")
    rules_ = [quality.Rule("key", lambda: quality.required_nulls(["id"]), "FATAL"), quality.Rule("id", lambda: quality.bad_identifier("id"), "SEVERE", ("key",))]
    assert [(r.status, r.blocks) for r in quality.run_rules(df, rules_).collect()] == [("FAIL", True), ("SKIPPED", False)]
    assert [r.status for r in quality.run_rules(df.where("id is not null"), rules_).collect()] == ["PASS", "FAIL"]
    assert [r.status for r in quality.run_rules(df.limit(0), rules_).collect()] == ["FAIL", "SKIPPED"]
    assert quality.schema_differences(df, df.schema) == [] and quality.schema_differences(df.drop("d"), df.schema)
    fin = spark.createDataFrame([(date(2024, 3, 31), date(2024, 4, 1)), (date(2024, 3, 30), date(2024, 4, 1)), (date(2024, 6, 30), date(2024, 6, 1))], "report_period date, announcement_date date")
    assert quality.counts(fin, {"bad": quality.financial_violations()}).first().bad == 2


def test_rules_have_no_gaps_and_round_half_up(spark):
    assert rules.broken_intervals(rules.price_limit_table(spark), ["limit_group", "status"]).count() == 0
    rows = spark.createDataFrame([("MAIN", "NORMAL", date(2024, 1, 2), 1005), ("MAIN", "ST", date(2024, 1, 2), 1010), ("STAR", "NORMAL", date(2000, 1, 1), 1000)], "limit_group string, status string, trade_date date, preclose_ticks long")
    got = {(r.limit_group, r.status): (r.upper_ticks, r.lower_ticks) for r in rules.price_limits(rows).collect()}
    assert got == {("MAIN", "NORMAL"): (1106, 905), ("MAIN", "ST"): (1061, 960), ("STAR", "NORMAL"): (None, None)}


def test_backtest_books_balance(spark, sf_dir):
    from panelspark.plans.market import _orders, _traded

    cash = 100_000_000
    prepared = backtest.prepared_orders(_orders(spark, sf_dir), _traded(spark, sf_dir)).cache()
    fills = backtest.run_backtests(prepared, cash).collect()
    assert len(fills) == prepared.count() and {r.reason for r in fills} >= {"FILLED", "SHORT_NOT_SUPPORTED"}
    caps = {(r.run_id, r.trade_date, r.instrument_id, r.side): r.capacity for r in prepared.collect()}
    held, money, bought = {}, {}, {}
    for r in sorted(fills, key=lambda r: (r.run_id, r.trade_date, r.side != "SELL", r.instrument_id)):
        k = (r.run_id, r.instrument_id)
        assert 0 <= r.filled <= min(r.requested, caps[r.run_id, r.trade_date, r.instrument_id, r.side]) and (r.filled or not r.fees)
        if r.filled:
            gross = r.filled * r.price_ticks
            assert r.fees == backtest.commission(gross)
            if r.side == "SELL":
                assert r.filled <= held.get(k, 0) - bought.get((*k, r.trade_date), 0)
                held[k] -= r.filled
                money[r.run_id] = money.get(r.run_id, cash) + gross - r.fees
            else:
                held[k] = held.get(k, 0) + r.filled
                bought[*k, r.trade_date] = bought.get((*k, r.trade_date), 0) + r.filled
                money[r.run_id] = money.get(r.run_id, cash) - gross - r.fees
            assert r.cash == money[r.run_id] >= 0


def test_affordable_is_the_largest():
    for cash in (0, 500, 12_345, 1_000_000):
        n = backtest.affordable(cash, 123, 100_000, 100)
        cost = lambda q: q * 123 + backtest.commission(q * 123)
        assert cost(n) <= cash and (n + 100 > 100_000 or cost(n + 100) > cash)


def test_ledger_looks_at_unsettled_lots_only():
    class Lots(backtest.deque):
        seen = 0

        def __reversed__(self):
            for x in super().__reversed__():
                Lots.seen += 1
                yield x

        def __iter__(self):
            raise AssertionError("all lots are walked through")

    ledger = backtest.Ledger(10**12, 2)
    ledger.lots[7] = Lots()
    for session in range(500):
        ledger.buy(7, session, 100, 1000, 5)
        assert ledger.held(7) == 100 * (session + 1) and ledger.sellable(7, session) == 100 * max(0, session - 1)
    assert Lots.seen <= 3 * 500
    assert ledger.sell(7, 500, 150, 3000, 5) == 3000 - 5 - 1005 - 503 and ledger.held(7) == 49850 and ledger.sellable(8, 1) == 0


def test_equity_is_spread_over_sessions_after_the_last_shuffle(spark):
    rng = random.Random(21)
    days = [date(2024, 1, 1) + timedelta(d) for d in range(40)]
    marks = [(d, i, rng.choice([None, rng.randrange(900, 1100)]) if rng.random() < 0.3 else rng.randrange(900, 1100)) for d in days for i in range(6) if rng.random() < 0.6]
    sessions, fills, want = sorted({m[0] for m in marks}), [], {}
    for run in range(4):
        held = dict.fromkeys(range(6), 0)
        for d in sorted(rng.sample(sessions, 12)):
            for i in sorted(rng.sample(range(6), 3)):
                for side in ("SELL", "BUY"):
                    n = rng.randrange(held[i] + 1) if side == "SELL" else 100 * rng.randrange(3)
                    held[i] += n if side == "BUY" else -n
                    fills.append((run, d, i, side, n, rng.randrange(900, 1100) if n else None, 5 if n else 0))
    fills.append((9, sessions[3], 2, "BUY", 0, None, 0))  # a run that fills nothing
    for run in (0, 1, 2, 3, 9):
        for s in sessions:
            done = [f for f in fills if f[0] == run and f[1] <= s]
            cash = 10_000 + sum((-1 if f[3] == "BUY" else 1) * f[4] * (f[5] or 0) - f[6] for f in done)
            last = {i: max(((d, c) for d, j, c in marks if j == i and d <= s and c is not None), default=(s, 0))[1] for i in range(6)}
            value = sum((f[4] if f[3] == "BUY" else -f[4]) * last[f[2]] for f in done)
            want[run, s] = (cash, value, cash + value)
    f = spark.createDataFrame(fills, "run_id long, trade_date date, instrument_id long, side string, filled long, price_ticks long, fees long")
    out = backtest.marked_to_market(f, spark.createDataFrame(marks, "trade_date date, instrument_id long, close_ticks long"), 10_000)
    got = {(r.run_id, r.trade_date): (r.cash, r.market_value, r.equity) for r in out.collect()}
    assert out.count() == len(got) and got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert "explode(slice(" in plan and executed.index("explode(slice(") < executed.index("Exchange hashpartitioning")
