from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import streaming
from panelspark.operators import actions, portfolio

D0 = date(2024, 1, 1)


def test_best_weights_beat_other_weights():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        root = rng.normal(size=(n, n))
        cov, s, held, most = root @ root.T / n, rng.normal(0.3, 0.6, n), rng.uniform(0, 0.3, n) * rng.integers(0, 2, n), rng.uniform(0.05, 0.9, n)
        value = lambda w: s @ w - 0.7 * w @ cov @ w - 0.05 * np.abs(w - held).sum()  # noqa: B023, E731
        w = portfolio.best_weights(s, cov, held, most, 0.7, 0.05)
        assert (w >= 0).all() and (w <= most + 1e-9).all() and w.sum() <= 1 + 1e-9
        for _ in range(300):
            x = np.clip(w + rng.normal(0, rng.choice([1e-3, 0.05, 0.4]), n), 0, most)
            x = x / max(1.0, x.sum())
            assert value(x) <= value(w) + 1e-7
    flat = portfolio.best_weights(np.array([0.2, -0.2]), np.zeros((2, 2)), np.zeros(2), np.array([0.4, 0.4]), 1.0, 0.0)
    assert flat.tolist() == [0.4, 0.0]


def slow_limited(rows, most, cap, limit):
    """rows: name -> (now, goal, rank); None where it is an error."""
    one_way = lambda held: sum(abs(held.get(k, 0.0) - now) for k, (now, _, _) in rows.items()) / 2
    held = {k: min(now, cap) for k, (now, _, _) in rows.items() if now > 0}
    if len(held) > most or one_way(held) > limit + 1e-12:
        return None
    drops = sorted((now, k) for k, (now, goal, _) in rows.items() if now > 0 and goal <= 0)
    for _, k in sorted((rank, k) for k, (now, goal, rank) in rows.items() if goal > 0 and now <= 0):
        new = held | {k: rows[k][1]}
        if len(new) > most:
            if not drops:
                continue
            new.pop(drops[0][1])
        if one_way(new) <= limit + 1e-12:
            drops = drops[1:] if len(held) + 1 > most else drops
            held = new
    best = held
    for i in range(10_001):
        moved = {k: w + i / 10_000 * ((rows[k][1] or w) - w) for k, w in held.items()}
        best = moved if one_way(moved) <= limit + 1e-12 else best
    return best


def test_turnover_limit_against_plain_python(spark):
    rng, data, want = random.Random(7), [], {}
    for d in range(60):
        names = rng.sample(range(12), 9)
        rows = {k: (round(rng.uniform(0.01, 0.25), 3) if i < 4 else 0.0, round(rng.uniform(0.01, 0.15), 3) if i >= 2 and i != 5 else 0.0, i if i % 3 else 3) for i, k in enumerate(names)}
        most, limit = 5, 0.35
        got = slow_limited(rows, most, 0.2, limit)
        if got is not None:
            want[d] = got
            data += [(D0 + timedelta(d), k, now or None, goal, rank) for k, (now, goal, rank) in rows.items()]
    df = spark.createDataFrame(data, "signal_date date, instrument_id long, current_weight double, target_weight double, target_rank int")
    out = {}
    for r in portfolio.turnover_limited(df, 5, 0.2, 0.35).collect():
        out.setdefault((r.signal_date - D0).days, {})[r.instrument_id] = r.target_weight
    assert out.keys() == want.keys() and len(want) > 40
    for d, rows in want.items():
        assert out[d] == pytest.approx(rows, abs=2e-4), d
    with pytest.raises(Exception, match="more positions"):
        portfolio.turnover_limited(df, 3, 0.2, 0.35).collect()
    with pytest.raises(Exception, match="limit on a weight"):
        portfolio.turnover_limited(df, 5, 0.01, 0.01).collect()


def test_assembled_query_against_plain_python(spark, sf_dir):
    from panelspark.plans import QUERIES
    from panelspark.plans.decisions import _candidates

    days = {}
    for r in _candidates(spark, sf_dir).collect():
        days.setdefault(r.signal_date, []).append(r)
    got = {}
    for r in QUERIES["assembled_portfolio"](spark, sf_dir).collect():
        got.setdefault(r.signal_date, {})[r.instrument_id] = r.target_weight
    assert len(got) > 50
    for day, rows in days.items():
        fine = sorted((-r.score, r.instrument_id) for r in rows if r.score is not None)
        rest = sorted(r.instrument_id for r in rows if r.score is None)
        place = {i: n for n, i in enumerate([*(i for _, i in fine), *rest], 1)}
        chosen = {i for _, i in fine[:10]}
        weight = {r.instrument_id: min(1 / len(chosen), 0.12) if r.instrument_id in chosen else 0.0 for r in rows}
        of = {r.instrument_id: r.industry for r in rows}
        total = {}
        for i, w in weight.items():
            total[of[i]] = total.get(of[i], 0.0) + w
        goal = {i: w * min(1.0, 0.3 / total[of[i]]) if total[of[i]] else 0.0 for i, w in weight.items()}
        want = slow_limited({i: (0.1 if i < 8 else 0.0, goal[i], place[i]) for i in weight}, 10, 0.12, 0.4)
        assert got.get(day, {}) == pytest.approx(want, abs=2e-4), day


def test_hac_query_has_normal_p_values(spark, sf_dir):
    from math import erfc, sqrt

    from panelspark.plans import QUERIES

    rows = {r.factor_id: r for r in QUERIES["hac_inference"](spark, sf_dir).collect()}
    plain = {r.factor_id: r for r in QUERIES["hac_mean"](spark, sf_dir).collect()}
    assert rows.keys() == plain.keys() and rows
    for k, r in rows.items():
        assert r.p_value == pytest.approx(erfc(abs(r.t) / sqrt(2))) and (round(r.mean, 8), round(r.se, 8)) == (plain[k]["mean"], plain[k].se)


def test_constructors_over_dates(spark):
    rows = [(D0 + timedelta(d), i, float((i * 7 + d) % 5), 0.1 if i < 2 else 0.0, 0.5, f"n{i % 2}") for d in (0, 1) for i in range(6)]
    c = spark.createDataFrame(rows, "signal_date date, instrument_id long, score double, current_weight double, capacity_limit double, industry string")
    cov = spark.createDataFrame([(i, j, 0.04 if i == j else 0.01) for i in range(6) for j in range(i, 6)], "instrument_x long, instrument_y long, covariance double")
    out = portfolio.alpha_risk_cost(c, cov, 4, 0.4)
    sums = {r.signal_date: (r.n, r.s) for r in out.groupBy("signal_date").agg(F.count("*").alias("n"), F.sum("target_weight").alias("s")).collect()}
    assert all(n == 4 and s <= 1 + 1e-9 for n, s in sums.values()) and len(sums) == 2
    assert out.where("target_weight > 0.4000001 or target_weight < 0").isEmpty()
    done = portfolio.assembled(c, 4, 0.3, 0.4, 0.5).groupBy("signal_date").agg(F.sum("target_weight").alias("s")).collect()
    assert len(done) == 2 and all(r.s <= 1 + 1e-9 for r in done)
    assert portfolio.assembled(c.limit(0), 4, 0.3, 0.4, 0.5).count() == 0


def test_actions_are_due_at_the_record_close(spark):
    events = spark.createDataFrame(
        [("A", D0, D0, D0 + timedelta(1), D0 + timedelta(4), D0 + timedelta(3), 0.125, 0.3, None)], "instrument_id string, report_period date, record_date date, ex_date date, pay_date date, listing_date date, cash_per_share double, stock_per_share double, x string"
    )
    splits = spark.createDataFrame([("B", D0, 2.0, 0.0001)], "instrument_id string, trade_date date, split_ratio double, relative_error double")
    held = spark.createDataFrame([(1, D0, "A", 101), (1, D0, "B", 50), (2, D0, "A", 0), (1, D0 + timedelta(1), "A", 900)], "run_id int, trade_date date, instrument_id string, quantity long")
    due = {r.instrument_id: r for r in actions.entitlements(actions.assembled_actions(events, splits), held).collect()}
    assert (due["A"].cash_cents, due["A"].new_shares) == (1263, 30) and (due["B"].cash_cents, due["B"].new_shares) == (0, 50)
    bad = splits.withColumn("relative_error", F.lit(0.2))
    with pytest.raises(Exception, match="split ratio"):
        actions.assembled_actions(events, bad).collect()
    days = spark.createDataFrame([(D0 + timedelta(i), True) for i in range(6)], "trade_date date, is_trading_day boolean")
    open_ = {r.trade_date: r.dividend_receivable for r in actions.receivables(actions.entitlements(actions.assembled_actions(events, splits), held), days).collect()}
    assert [open_[D0 + timedelta(i)] for i in range(6)] == [0, 1263, 1263, 1263, 0, 0]
    late = days.where(F.col("trade_date") > F.lit(D0))
    assert actions.mapped_to_sessions(events, late, {"record_date": "s"}).first().s == D0 + timedelta(1)


def test_stream_resumes_where_it_was(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), "id")
    rows.where("id < 60").coalesce(1).write.parquet(f"{tmp_path}/in")
    first = streaming.drained(spark, f"{tmp_path}/in", f"{tmp_path}/out").agg(F.sum("n_events")).first()[0]
    rows.where("id >= 60").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    both = streaming.drained(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert (first, both.agg(F.sum("n_events")).first()[0]) == (60, 100)
    assert both.count() == 17
