from __future__ import annotations

import random
from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd
from compare import assert_same
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark import plans
from panelspark.functions.numeric import average_rank
from panelspark.operators import decisions, factors, performance, study
from panelspark.operators import windows as win
from panelspark.plans import tables

D0 = date(2024, 1, 1)


def day(i: int) -> date:
    return D0 + timedelta(days=i)


def nav(spark, *rows):
    return performance.daily_returns(spark.createDataFrame([(p, day(i), e, b) for p, es, bs in rows for i, (e, b) in enumerate(zip(es, bs))], "portfolio_id int, trade_date date, equity long, benchmark long"))


def test_total_losses_and_zero_divisors(spark):
    r = nav(spark, (1, [100, 0, 50], [10, 10, 10]), (2, [100, 110, 121], [0, 0, 0]), (3, [0, 100, 110], [5, 0, 5]), (4, [7], [7]))
    fees = spark.createDataFrame([(1, day(2), 5), (2, day(1), 11)], "portfolio_id int, trade_date date, fees long")
    g = {(x.portfolio_id, (x.trade_date - D0).days): x.gross_growth for x in performance.gross_growth(r, fees).collect()}
    assert [g[1, i] for i in range(3)] == [1.0, 0.0, 0.0] and abs(g[2, 1] - 1.21) < 1e-12
    rel = {x.portfolio_id: x for x in performance.relative_performance(r).collect()}
    assert rel[2].benchmark_cumulative_return is None and rel[2].annualized_reason == "ANNUALIZED_RETURN_NOT_AVAILABLE"
    assert rel[3].annualized_reason == "ANNUALIZED_RETURN_NOT_AVAILABLE" and rel[4].annualized_reason == "INSUFFICIENT_OBSERVATIONS" and rel[1].annualized_reason is None
    fills = spark.createDataFrame([(1, day(2), 3, 3, 1.0, 100, 1)], "portfolio_id int, trade_date date, requested_quantity long, filled_quantity long, reference_price double, gross_value long, fees long")
    t = {x.portfolio_id: x for x in performance.trading_metrics(r, fills).collect()}
    assert t[1].gross_cumulative_return == -1.0 and t[1].annualized_reason == "ANNUALIZED_RETURN_NOT_AVAILABLE" and t[4].annualized_reason == "INSUFFICIENT_OBSERVATIONS"
    held = spark.createDataFrame([(1, day(1), 9, 5)], "portfolio_id int, trade_date date, security int, market_value long")
    h = {x.portfolio_id: x for x in performance.holding_metrics(r.withColumns({"cash": F.lit(1), "dividend_receivable": F.lit(0)}), held).collect()}
    assert h[1].max_position_weight == 0.0 and h[3].average_cash_weight is not None
    assert performance.rolling_block(r, 2).count() == 3


def test_relative_performance_over_a_benchmark_that_passes_zero(spark, tmp_path):
    steps = [  # day, rows, quantity, line number: each row moves the equity by quantity - 25 and the benchmark by line number - 4
        (0, 1, 26, 5), (1, 1, 30, 3), (2, 333, 26, 1), (3, 1, 26, 3), (4, 2, 20, 7), (5, 40, 1, 7), (6, 9, 26, 7), (7, 1, 30, 4),
    ]
    parts = " UNION ALL ".join(f"SELECT {1 + nation} AS l_suppkey, TIMESTAMP '1993-05-28' + INTERVAL {d} DAY AS l_shipdate, {q + (nation == 7 and d == 3) * -20}.0::DOUBLE AS l_quantity, {k} AS l_linenumber FROM range({n})" for nation in (3, 7) for d, n, q, k in steps)
    duckdb.sql(f"COPY ({parts}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT 1 + n::BIGINT AS s_suppkey, n::INTEGER AS s_nationkey FROM range(25) t(n)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    nav = {(r.portfolio_id, r.benchmark) for r in plans.QUERIES["daily_returns"](spark, str(tmp_path)).collect()}
    assert {(3, 0), (7, 0)} <= nav
    assert assert_same(plans.QUERIES["relative_performance"], plans.SQL["relative_performance"], spark, str(tmp_path)) == 6


def test_rolling_falls_against_all_pairs(spark):
    rng = random.Random(2)
    x = [max(0, round(100 + 30 * rng.gauss(0, 1))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(x)), "t int, v int").withColumn("k", F.lit(1))
    w = Window.partitionBy("k").orderBy("t")
    for n in (1, 2, 7, 8, 21):
        got = [r.fall for r in win.with_rolling_fall(df, F.col("v").cast("double"), w, n, "fall").orderBy("t").collect()]
        for i in range(len(x)):
            want = min([0.0, *(x[b] / x[a] - 1 for a in range(i - n + 1, i + 1) for b in range(a, i + 1) if x[a] > 0)]) if i >= n - 1 else None
            assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
    plan = win.with_rolling_fall(df, F.col("v").cast("double"), w, 253, "fall")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "collect_list" not in plan


def test_running_products_keep_signs_and_zeros(spark):
    x = [1.5, None, -2.0, 0.5, -1.0, 0.0, 3.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, t int, v double")
    got = [r.p for r in df.select("t", win.running_product("v", Window.partitionBy("k").orderBy("t")).alias("p")).orderBy("t").collect()]
    assert np.allclose(got, [1.5, 1.5, -3.0, -1.5, 1.5, 0.0, 0.0])


def test_covariances_by_blocks_and_ranges_with_missing_cells(spark):
    rng = random.Random(3)
    cells = {(day(d), i): rng.gauss(0, 0.02) + 5 for d in range(37) for i in range(23) if rng.random() < 0.8 and (i != 4 or d < 3)}
    rows = [(d, i, v) for (d, i), v in cells.items()] + [(day(40), 1, None), (day(40), 2, float("nan"))]
    df = spark.createDataFrame(rows, "trade_date date, instrument_id int, r double")
    days = sorted({r[0] for r in rows})
    x = np.array([[cells.get((d, i), 0.0) for d in days] for i in range(23)])
    want = np.cov(x)
    for block, span in ((512, 4096), (5, 10), (23, 1)):
        got = decisions.shrunk_covariance(df, 0.1, block, span).collect()
        assert len(got) == 23 * 24 // 2
        for r in got:
            assert abs(r.covariance - want[r.instrument_x, r.instrument_y] * (1 if r.instrument_x == r.instrument_y else 0.9)) < 1e-9
    one = decisions.shrunk_covariance(df.where(F.col("trade_date") == day(0))).collect()
    assert one and all(r.covariance is None for r in one)
    assert decisions.shrunk_covariance(df.limit(0)).count() == 0


def test_covariance_blocks_grow_where_dates_are_few(spark, monkeypatch):
    monkeypatch.setattr(decisions, "BLOCK_SERIES", 2)
    monkeypatch.setattr(decisions, "RANGE_DATES", 40)
    monkeypatch.setattr(decisions, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(decisions, "STRIP_PAIRS", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.02, (60, 4))
    df = spark.createDataFrame([(day(d), i, float(x[i, d])) for i in range(60) for d in range(4)], "trade_date date, instrument_id int, r double")
    out = decisions.shrunk_covariance(df)
    got = {(r.instrument_x, r.instrument_y): r.covariance for r in out.collect()}
    want = np.cov(x) * np.where(np.eye(60) > 0, 1, 0.9)
    assert len(got) == 60 * 61 // 2 and all(abs(c - want[i, j]) < 1e-12 for (i, j), c in got.items())
    # a series is sent once for each block: 3 of 20 instruments over four dates, not 30 of two
    assert "sequence(0, 2" in out._jdf.queryExecution().analyzed().toString()


def test_correlations_on_common_instruments(spark):
    rng = random.Random(5)
    rows = [(day(d), i, f, float(rng.randrange(6)), True) for d in range(6) for i in range(12) for f in ("a", "b", "c") if rng.random() < 0.8]
    rows += [(day(d), i, "flat", 1.0, True) for d in range(6) for i in range(12)] + [(day(0), 3, "d", 2.0, True), (day(0), 4, "d", float("nan"), True), (day(0), 5, "d", 1.0, False)]
    df = spark.createDataFrame(rows, "signal_date date, instrument_id int, factor_id string, value double, is_valid boolean")
    got = {(r.factor_x, r.factor_y): (r.n_dates, r.n_pairs, r.pearson, r.rank) for r in study.factor_correlations(df).collect()}
    table = pd.DataFrame([r for r in rows if r[4] and r[3] == r[3]], columns=["d", "i", "f", "v", "ok"])
    for x in "abc":
        for y in "abc":
            days, n, ps, rs = 0, 0, [], []
            for _, part in table.groupby("d"):
                wide = part[part["f"].isin([x, y])].pivot(index="i", columns="f", values="v").dropna()
                a, b = wide[x], wide[y]
                if len(wide) >= 3 and a.nunique() > 1 and b.nunique() > 1:
                    days, n = days + 1, n + len(wide)
                    ps.append(np.corrcoef(a, b)[0, 1])
                    rs.append(np.corrcoef(a.rank(), b.rank())[0, 1])
            assert got[x, y][:2] == (days, n) and abs(got[x, y][2] - np.mean(ps)) < 1e-9 and abs(got[x, y][3] - np.mean(rs)) < 1e-9
    assert not any("flat" in k or "d" in k for k in got) and study.factor_correlations(df.limit(0)).count() == 0


def test_average_ranks_share_one_shuffle(spark):
    rng = random.Random(8)
    rows = [(d, rng.choice([0.0, -0.0, 1.5, -2.0, float(rng.randrange(9))]), float(rng.randrange(5))) for d in range(4) for _ in range(60)]
    df = spark.createDataFrame(rows, "d int, x double, y double")
    out = df.withColumns({"rx": average_rank("x", "d"), "ry": average_rank("y", "d")})
    got = sorted((r.d, r.x, r.y, r.rx, r.ry) for r in out.collect())
    table = pd.DataFrame(rows, columns=["d", "x", "y"])
    table["rx"], table["ry"] = table.groupby("d")["x"].rank(), table.groupby("d")["y"].rank()
    assert got == sorted(tuple(r) for r in table.itertuples(index=False))
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_a_study_reads_its_lines_once(spark, sf_dir, monkeypatch):
    seen, load = [], tables.load
    monkeypatch.setattr(tables, "load", lambda s, d, name: seen.append(name) or load(s, d, name))
    assert plans.QUERIES["study_artifacts"](spark, sf_dir).count() == 11
    assert seen == ["lineitem"]

def test_signal_variants_are_not_dealt_by_factor(spark, sf_dir):
    plan = plans.QUERIES["signal_variants"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(factor_id" not in plan and "CartesianProduct" not in plan and plan.count("Window") == 4  # two windows, of each branch: the lag and all factors


def test_market_factors_of_one_pass_equal_each_alone(spark):
    rng = random.Random(11)
    rows = [(i, day(d), None if rng.random() < 0.15 else rng.gauss(0, 0.1), None if rng.random() < 0.1 else day(d)) for i in range(9) for d in range(15 - i)]
    panel = spark.createDataFrame(rows, "instrument_id int, trade_date date, log_return double, available_at date")
    want = {"a": (factors.period_return(2), 3), "b": (factors.volatility(4), 5), "c": (factors.period_return(1), 2)}
    alone = [tuple(r) for k, (v, n) in want.items() for r in factors.market_factor(k, v, n)(panel).collect()]
    assert sorted(map(str, map(tuple, factors.market_factors(want)(panel).collect()))) == sorted(map(str, alone))
    assert {r[-1] for r in alone} == {None, "INSUFFICIENT_HISTORY", "AVAILABILITY_UNKNOWN", "NONFINITE_VALUE"}

def test_cost_models_read_their_names_once(spark, sf_dir):
    plan = plans.QUERIES["cost_estimates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Union" not in plan
    names = spark.createDataFrame([(day(0), 1, 200.0, 4000), (day(0), 2, -5.0, 0)], "signal_date date, instrument_id int, amount double, equity_cents long")
    got = decisions.cost_estimates_by_model(names, ["sqrt_impact", "linear_impact", "none"], 2.5, 500, 30.0)
    for m in ("sqrt_impact", "linear_impact", "none"):
        assert sorted(map(tuple, got.where(F.col("model") == m).drop("model").collect())) == sorted(map(tuple, decisions.cost_estimates(names, m, 2.5, 500, 30.0).collect()))
    assert {(r.model, r.linear, r.square_root) for r in got.collect()} == {("sqrt_impact", 0.00025, 0.003), ("linear_impact", 0.00025 + 0.003, 0.0), ("none", 0.00025, 0.0)}


def test_strategy_tables_share_bars_and_net_asset_values(spark, sf_dir, monkeypatch):
    seen, load = [], tables.load
    for module in (tables, plans.decisions, plans.artifacts, plans.more):
        monkeypatch.setattr(module, "load", lambda s, d, name: seen.append(name) or load(s, d, name))
    assert plans.QUERIES["strategy_artifacts"](spark, sf_dir).count() == 15
    assert seen.count("lineitem") == 5  # values, bars, numbered lines, lots, exposures
