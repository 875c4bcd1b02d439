from __future__ import annotations

import random
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import clock, text
from panelspark.operators import decisions, masters, portfolio, relational, review
from panelspark.plans.decisions import _candidates
from panelspark.plans.more import optimized_portfolio
from panelspark.plans.tables import panel

D0 = date(2024, 1, 1)
UTC = ZoneInfo("UTC")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Shanghai", "Europe/London"])
def test_clock_through_changes_of_the_hour(spark, zone):
    rng, z = random.Random(5), ZoneInfo(zone)
    instants = [datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(366 * 1440)) for _ in range(400)] + [datetime(2024, 3, 10, 6, 59), datetime(2024, 3, 10, 7), datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30), datetime(1969, 12, 31, 23)]
    rows = spark.createDataFrame([(t,) for t in instants] + [(None,)], "t timestamp_ntz")
    out = rows.select("t", clock.local_time("t", zone).alias("wall"), clock.local_day("t", zone).alias("day"), clock.trading_day("t", "15:30:00", zone).alias("session"), clock.day_end(clock.local_day("t", zone), zone).alias("end"), clock.at_time(clock.local_day("t", zone), "15:30:00", zone).alias("close")).collect()
    as_utc = lambda wall: wall.replace(tzinfo=z).astimezone(UTC).replace(tzinfo=None)
    for r in out:
        if r.t is None:
            assert all(x is None for x in r)
            continue
        wall = r.t.replace(tzinfo=UTC).astimezone(z).replace(tzinfo=None)
        close = datetime.combine(wall.date(), time(15, 30))
        assert r.wall == wall and r.day == wall.date() and r.session == wall.date() + timedelta(wall >= close)
        assert r.close == as_utc(close) and r.end == as_utc(datetime.combine(wall.date(), time.max))


def test_clock_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 20),)], "t timestamp_ntz")
    ask = lambda: df.select(clock.local_time("t", "Asia/Shanghai"), clock.trading_day("t", "15:00:00", "Asia/Shanghai"), clock.day_end(F.lit(D0), "Asia/Shanghai")).first()
    before = ask()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert ask() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before[0] == datetime(2024, 7, 2, 4) and before[2] == datetime(2024, 1, 1, 15, 59, 59, 999999)


def test_cleaned_strings(spark):
    values = [None, "", " ", "None", "nan ", " NaN", "20240229", "2023-02-29", " 2024-01-31\n", "2024-1-31", "12 000", "1e3", " 7 ", "true", "Y", "no", "600000.SH", "600000.SH ", "60000.SH", "600000.HK", "x" * 100_000]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.cleaned("v").alias("c"), text.to_day("v").alias("d"), text.to_number("v", 100).alias("n"), text.to_flag("v").alias("f"), text.is_code("v").alias("i"), text.year_of("v").alias("y")).collect()
    by = {r.v: r for r in rows}
    assert all(by[v].c is None and by[v].d is None and by[v].n is None and by[v].f is None for v in values[:6])
    assert by["20240229"].d == date(2024, 2, 29) and by["2023-02-29"].d is None and by[" 2024-01-31\n"].d == date(2024, 1, 31) and by["2024-1-31"].d is None
    assert by["12 000"].n is None and by["1e3"].n == 100_000.0 and by[" 7 "].n == 700.0
    assert {v for v in values if by[v].f} == {"true", "Y"} and by["no"].f is False
    assert {v for v in values if by[v].i} == {"600000.SH"} and by["20240229"].y == 2024 and by["600000.SH"].y == 6000 and by["no"].y is None


def test_listed_sessions_against_every_day(spark):
    rng = random.Random(2)
    days = [(D0 + timedelta(i), rng.random() < 0.6) for i in range(60)]
    some = lambda: None if rng.random() < 0.2 else D0 + timedelta(rng.randrange(-20, 80))
    master = [(i, some(), some()) for i in range(150)]
    m, d = spark.createDataFrame(master, "instrument_id long, list_date date, delist_date date"), spark.createDataFrame(days, "trade_date date, is_open boolean")
    start, end = D0 + timedelta(5), D0 + timedelta(50)
    got = {r.instrument_id: r.sessions for r in masters.listed_sessions(m, d, start, end).collect()}
    assert got == {i: sum(o and start <= x <= end and a is not None and a <= x and (b is None or b > x) for x, o in days) for i, a, b in master}
    assert masters.listed_sessions(m.limit(0), d, start, end).count() == 0
    with pytest.raises(ValueError):
        masters.calendar(d, end, start)


def test_instruments_and_industries_of_odd_rows(spark):
    raw = [(" 300001.SZ ", "growth", "2020-01-02", None), ("688001.SH", "science", "20200102", "bad"), ("830001.BJ", "growth", None, ""), ("60000.SH", None, None, None), (None, None, None, None), ("600001.SH", None, "None", "20210101"), ("600001.SH", None, "None", "20210101")]
    got = sorted(tuple(r) for r in masters.instruments(spark.createDataFrame(raw, "code string, market string, list_date string, delist_date string")).select("instrument_id", "exchange", "board", F.col("list_date").isNotNull(), F.col("delist_date").isNotNull()).collect())
    assert got == [("300001.SZ", "SZ", "CHINEXT", True, False), ("600001.SH", "SH", "MAIN", False, True), ("600001.SH", "SH", "MAIN", False, True), ("688001.SH", "SH", "STAR", True, False), ("830001.BJ", "BJ", "BSE", False, False)]
    rows = [("a", 1, None), ("b", 2, "a"), ("c", 3, "b"), ("d", 3, "x"), ("e", 2, None), ("f", 3, "a"), ("g", 3, "e"), ("h", None, "a"), ("i", 1, "a"), ("j", 2, "j"), ("k", 4, "c")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "code string, level int, parent_code string, name string, x int")
    paths = {r.code: (r.path, r.is_complete) for r in masters.industry_paths(df).collect()}
    assert paths == {"a": ("a", True), "b": ("a/b", True), "c": ("a/b/c", True), "d": ("d", False), "e": ("e", False), "f": ("f", False), "g": ("e/g", False), "h": ("h", False), "i": ("i", True), "j": ("j", False), "k": ("b/c/k", False)}
    assert {r.code for r in masters.orphans(df).collect()} == {"d", "e", "f", "j"}


@pytest.mark.parametrize("exclude", [True, False])
def test_market_review_against_plain_python(spark, exclude):
    rng = random.Random(9)
    days = [D0 + timedelta(i) for i in range(30) if i % 7 < 5]
    master = [(i, None if i == 3 else D0 + timedelta(rng.randrange(-5, 20)), D0 + timedelta(rng.randrange(0, 30)) if i % 3 == 0 else None) for i in range(25)]
    number = lambda: rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.05 else round(rng.uniform(1, 9), 2)
    bars = [(d, i, *[number() for _ in range(6)], number()) for d in days[1:] for i in range(27) if rng.random() < 0.8] + [(D0 + timedelta(5), 1, *[1.0] * 7)]
    states = lambda share: [(d, i) for d in days for i in range(27) if rng.random() < share] * 2
    suspended, warned = states(0.1), states(0.15)
    f = lambda rows, kind: spark.createDataFrame(rows, kind)
    shape = "trade_date date, instrument_id long"
    b = f(bars, shape + ", open double, high double, low double, close double, preclose double, change double, amount double")
    got = {r.trade_date: r for r in review.market_review(f(master, "instrument_id long, list_date date, delist_date date"), f([(d,) for d in days], "trade_date date"), b, f(suspended, shape), f(warned, shape), exclude).collect()}
    s, w, priced_of, amounts = set(suspended), set(warned), {(r[0], r[1]): r for r in bars}, []
    fine = lambda x: x is not None and np.isfinite(x)
    assert set(got) == set(days)
    for d in days:
        live = [i for i, a, z in master if a is not None and a <= d and (z is None or z > d) and not (exclude and (d, i) in w)]
        priced = [i for i in live if (d, i) in priced_of and (d, i) not in s and all(map(fine, priced_of[d, i][2:8]))]
        held = sum((d, i) in s for i in live)
        amounts.append(sum(priced_of[d, i][8] for i in live if (d, i) in priced_of and fine(priced_of[d, i][8])))
        r, due = got[d], len(live) - held
        assert (r.expected_count, r.priced_count, r.suspended_count, r.st_count) == (len(live), len(priced), held, sum((d, i) in w for i in live))
        assert r.missing_bar_count == max(due - len(priced), 0) and r.coverage_rate == (len(priced) / due if due > 0 else None)
        assert r.up == sum(priced_of[d, i][7] > 0 for i in priced) and (r.p50 is None) == (not priced)
        assert r.amount == pytest.approx(amounts[-1]) and r.average_5 == pytest.approx(np.mean(amounts[-5:])) and r.percentile_20 == pytest.approx(np.mean([x <= amounts[-1] + 1e-9 for x in amounts[-20:]]))
        assert (r.change is None) == (len(amounts) < 2 or amounts[-2] == 0)


def test_optimized_portfolio_query_by_plain_numpy(spark, sf_dir):
    """The whole query again, with pandas ranks, a NumPy covariance and each date's problem solved alone."""
    c = _candidates(spark, sf_dir).toPandas()
    c = c[np.isfinite(c["score"].astype(float))].sort_values(["signal_date", "score", "instrument_id"], ascending=[True, False, True])
    top = c.groupby("signal_date").head(10)
    r = panel(spark, sf_dir).join(spark.createDataFrame([(int(i),) for i in set(top["instrument_id"])], "instrument_id long"), "instrument_id", "left_semi").withColumnRenamed("log_return", "r")
    cov = {(q.instrument_x, q.instrument_y): q.covariance for q in decisions.shrunk_covariance(r).collect()}
    cov |= {(y, x): v for (x, y), v in cov.items()}
    want = {}
    for day, rows in top.groupby("signal_date"):
        ids, s = rows["instrument_id"].tolist(), rows["score"].to_numpy(float)
        held = np.maximum(rows["current_weight"].fillna(0).to_numpy(float), 0)
        cap = np.clip(np.minimum((rows["adv_amount"] / 1e6).fillna(0.2).to_numpy(float), 0.2), 0, None)
        v = np.array([[cov.get((x, y), 0.0) for y in ids] for x in ids])
        goal = portfolio.best_weights(s - s.mean(), v, held, cap, 1.0, 0.001)
        turnover = np.abs(goal - held).sum() / 2
        share = min(1.0, 0.6 / turnover) if turnover > 0 else 1.0
        want |= {(day, i): x for i, x in zip(ids, held + share * (goal - held))}
    got = {(r.signal_date, r.instrument_id): r.target_weight for r in optimized_portfolio(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got)
    assert any(x > 0.01 for x in got.values())


@pytest.mark.parametrize("lag", [-40, 0, 1, 75])
def test_interval_state_with_lagging_cutoffs(spark, lag):
    rng = random.Random(lag)
    day = lambda a=0, z=400: D0 + timedelta(rng.randrange(a, z))
    at = lambda d, hour=12: datetime.combine(d, time(hour))
    some = lambda x, share=0.2: None if rng.random() < share else x
    members = [(i, rng.randrange(30), day(), some(day(-30)), at(day()), some(at(day(-30)))) for i in range(200)]
    dates = [(d, at(d - timedelta(max(0, lag - rng.randrange(3)) if lag > 0 else lag), 18)) for d in sorted({day() for _ in range(60)})] + [(D0 + timedelta(401), None)]
    m = spark.createDataFrame(members, "n long, k long, in_date date, out_date date, in_known timestamp_ntz, out_known timestamp_ntz")
    d = spark.createDataFrame(dates, "date date, cutoff timestamp_ntz")
    state = lambda m, d: relational.interval_state(m, d, "k", "in_date", "out_date", "cutoff", "in_known", "out_known", [F.col("in_date").desc(), F.col("n")])
    want = {}
    for on, cutoff in dates[:-1]:
        for n, k, a, z, a_known, z_known in sorted(members, key=lambda r: (r[2], -r[0])):
            if a <= on and a_known <= cutoff and not (z is not None and z <= on and z_known is not None and z_known <= cutoff):
                want[on, k] = n
    assert {(r.date, r.k): r.n for r in state(m, d).collect()} == want and len(want) > 100
    assert state(m, d.limit(0)).count() == 0 and state(m.limit(0), d).count() == 0


def test_interval_state_of_memberships_with_the_same_times(spark):
    rng = random.Random(9)
    rows = [(n % 2, date(2024, 1, 1 + n % 5), date(2024, 1, 3), date(2024, 3, 9) if n % 3 else None, date(2024, 3, 20) if n % 3 == 1 else None, rng.random()) for n in range(600)]
    m = spark.createDataFrame(rows, "k int, in_date date, in_known date, out_date date, out_known date, n double")
    days = [date(2024, i, 15) for i in range(1, 8)]
    d = spark.createDataFrame([(x, x) for x in days], "date date, cutoff date")
    out = relational.interval_state(m, d, "k", "in_date", "out_date", "cutoff", "in_known", "out_known", [F.col("in_date").desc(), F.col("n")])
    valid = lambda r, x: r[1] <= x and r[2] <= x and not (r[3] and r[4] and r[3] <= x and r[4] <= x)
    want = {(x, k): min((-r[1].toordinal(), r[5]) for r in rows if r[0] == k and valid(r, x)) for x in days for k in (0, 1)}
    assert {(r.date, r.k): (-r.in_date.toordinal(), r.n) for r in out.collect()} == want
    # rows are cut down to one for each key and its times before they meet the dates
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.rindex("Generate ") :]
