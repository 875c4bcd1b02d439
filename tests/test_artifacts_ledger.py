from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from panelspark.operators import decisions, lots, relational, scan
from panelspark.sources import artifacts
from panelspark.sources.artifacts import Contract

TWO = {"a": Contract(("k",), "k int, v string"), "b": Contract(("k", "d"), "k int, d date, x double")}
D0 = date(2024, 1, 1)


def tables(spark, n=50, mark="x"):
    a = spark.createDataFrame([(n - i, f"{mark}{i}") for i in range(n)], "k int, v string")
    b = spark.createDataFrame([(i % 7, D0 + timedelta(days=i), i / 3) for i in range(n)], "k int, d date, x double")
    return {"a": a, "b": b.select("x", "d", "k", F.lit(1).alias("more"))}


def everything(spark, run):
    return {n: sorted(map(tuple, artifacts.read_table(spark, run, n, TWO).collect())) for n in TWO}


def test_runs_are_read_back_equal_and_in_order(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    given = tables(spark)
    run = artifacts.publish_run(spark, given, TWO, root, "r1")
    assert everything(spark, run) == {n: sorted(map(tuple, given[n].select(*TWO[n].types()).collect())) for n in TWO}
    assert [r.k for r in spark.read.parquet(f"{run}/a").collect()] == list(range(1, 51))
    with pytest.raises(FileExistsError):
        artifacts.publish_run(spark, given, TWO, root, "r1")
    artifacts.publish_run(spark, tables(spark, 9, "y"), TWO, root, "r1", replace=True)
    assert len(everything(spark, run)["a"]) == 9
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if not p.name.endswith(".crc")) == ["r1"]


def test_a_failed_run_leaves_the_old_one(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/runs"
    run = artifacts.publish_run(spark, tables(spark), TWO, root, "r1")
    before = everything(spark, run)
    fails = tables(spark, 20, "z")
    dies = fails["b"].withColumn("x", F.when(F.col("k") == 3, F.raise_error(F.lit("lost midway")).cast("double")).otherwise(F.col("x")))
    bad = {
        "lost midway": fails | {"b": dies},
        "do not meet": {"a": fails["a"]},
        "columns": fails | {"a": fails["a"].withColumn("k", F.col("k").cast("long"))},
        "'repeated_keys': 1": fails | {"a": fails["a"].union(fails["a"].limit(1))},
        "'null_keys': 1": fails | {"b": fails["b"].union(spark.createDataFrame([(1.0, None, 1, 1)], "x double, d date, k int, more int"))},
    }
    for message, given in bad.items():
        with pytest.raises(Exception, match=message):
            artifacts.publish_run(spark, given, TWO, root, "r1", replace=True)
        assert everything(spark, run) == before
    moved, times = artifacts.move, []

    def breaks(s, a, b):
        times.append(a)
        if len(times) == 2:
            raise OSError("no rename")
        moved(s, a, b)

    monkeypatch.setattr(artifacts, "move", breaks)
    with pytest.raises(OSError, match="no rename"):
        artifacts.publish_run(spark, fails, TWO, root, "r1", replace=True)
    assert everything(spark, run) == before
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if not p.name.endswith(".crc")) == ["r1"]


def test_violations_see_unordered_rows(spark, tmp_path):
    rows = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/a")
    found = artifacts.violations(spark.read.parquet(f"{tmp_path}/a"), "a", TWO["a"], 5).first()
    assert (found.missing_rows, found.null_keys, found.repeated_keys) == (1, 1, 0) and found.unordered >= 1


def slow_lots(held, actions):
    """The ledger day by day: actions at the open, buys, entitlements at the close."""
    out = []
    days = sorted({x[3] for x in held} | {a[k] for a in actions for k in ("record", "ex")})
    for key in sorted({(x[0], x[1]) for x in held}):
        mine, due = [], {}
        for d in days:
            for a in sorted((a for a in actions if a["inst"] == key[1] and a["ex"] == d), key=lambda a: a["id"]):
                total = sum(x["q"] for x in mine)
                n = floor(total * a["per"]) - total if a["split"] else due.get(a["id"], 0)
                if n:
                    mine.append({"kind": "STOCK", "lot": a["id"], "buy": d, "sell": a["list"], "q": n, "c": 0})
                    ordered = sorted(mine, key=lambda x: (x["buy"], x["sell"], x["kind"], x["lot"]))
                    cost, q = sum(x["c"] for x in mine), sum(x["q"] for x in mine)
                    for x in ordered:
                        x["c"] = cost * x["q"] // q
                    ordered[-1]["c"] += cost - sum(x["c"] for x in ordered)
            mine += [{"kind": "BUY", "lot": x[2], "buy": d, "sell": x[4], "q": x[5], "c": x[6]} for x in held if (x[0], x[1]) == key and x[3] == d]
            for a in actions:
                if a["inst"] == key[1] and a["record"] == d and not a["split"]:
                    due[a["id"]] = floor(sum(x["q"] for x in mine) * a["per"])
        out += [(*key, x["kind"], x["lot"], x["buy"], x["sell"], x["q"], x["c"]) for x in mine]
    return sorted(out)


def test_lots_under_actions_against_a_ledger(spark):
    rng = random.Random(4)
    day = lambda i: D0 + timedelta(days=i)
    held = [(r, i, 100 * r + n, day(d := rng.randrange(60)), day(d + 1), rng.randrange(1, 900), rng.randrange(10**7)) for r in (1, 2) for i in (1, 2, 3) for n in range(9)]
    acts = []
    for n in range(14):
        d, split = rng.randrange(5, 55), n % 4 == 0
        acts.append({"inst": 1 + n % 2, "id": n, "record": day(d), "ex": day(d if split else d + rng.randrange(1, 6)), "list": day(d + 7), "per": Fraction(rng.randrange(1, 40), 16) + (1 if split else 0), "split": split})
    h = spark.createDataFrame(held, "run_id int, instrument_id int, lot long, buy_date date, sellable_date date, quantity long, cost_cents long")
    a = spark.createDataFrame([(x["inst"], x["id"], x["record"], x["ex"], x["list"], float(x["per"]), "FUND_SPLIT" if x["split"] else "DIVIDEND") for x in acts], "instrument_id int, event_id long, record_date date, ex_date date, listing_date date, stock_per_share double, action_type string")
    got = sorted(map(tuple, lots.after_actions(h, a).collect()))
    assert got == slow_lots(held, acts) and len(got) > len(held)
    cost = lambda rows, at: [sum(r[at] for r in rows if (r[0], r[1]) == k) for k in sorted({(r[0], r[1]) for r in held})]
    assert cost(got, 7) == cost(held, 6)
    assert lots.after_actions(h.limit(0), a).count() == 0 and lots.after_actions(h, a.limit(0)).count() == len(held)


def test_targets_are_pursued_until_they_are_met(spark):
    day = lambda i: D0 + timedelta(days=i)
    weights = [0.0, 0.3, 0.45, 0.5, 0.2, 0.2, 0.6]
    sessions = spark.createDataFrame([(1, day(i)) for i in range(8)] + [(2, day(0))], "portfolio_id int, trade_date date")
    held = spark.createDataFrame([(1, day(i), "A", w) for i, w in enumerate(weights)] + [(1, day(6), "B", 0.3)], "portfolio_id int, trade_date date, instrument_id string, weight double")
    made = spark.createDataFrame([(1, day(1), "A", 0.5), (1, day(5), "A", 0.6)], "portfolio_id int, trade_date date, instrument_id string, weight double")
    got = {(r.portfolio_id, (r.trade_date - D0).days): r.state for r in decisions.pursued_targets(sessions, made, held, 0.06).collect()}
    assert got == {(1, 0): "IDLE", (1, 1): "PURSUED", (1, 2): "REACHED", (1, 3): "IDLE", (1, 4): "IDLE", (1, 5): "PURSUED", (1, 6): "PURSUED", (1, 7): "PURSUED", (2, 0): "IDLE"}


@pytest.mark.parametrize("strict", [False, True])
def test_asof_over_ranges_is_that_of_one_window(spark, strict):
    rng = random.Random(7)
    day = lambda i: D0 + timedelta(days=i)
    left = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, *(day(rng.randrange(400)) for _ in range(9))]), n) for n in range(3000)]
    right = {(rng.choice(["a", "a", "b", "c"]), day(rng.randrange(420))): rng.choice([None, rng.randrange(99)]) for _ in range(500)}
    lf = spark.createDataFrame(left, "k string, d date, n int")
    rf = spark.createDataFrame([(*k, v) for k, v in right.items()] + [("a", None, 5)], "k string, d date, v int")
    want = sorted(map(str, relational.asof_backward(lf, rf, ["k"], "d", ["v"], strict).collect()))
    for rows in (10, 300, 10**6):
        assert sorted(map(str, scan.asof_backward_ranges(lf, rf, ["k"], "d", ["v"], strict, rows).collect())) == want
    assert scan.asof_backward_ranges(lf.limit(0), rf, ["k"], "d", ["v"]).count() == 0
    assert scan.asof_backward_ranges(lf, rf.limit(0), ["k"], "d", ["v"]).where("v is not null").count() == 0


def test_running_values_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1]), rng.choice([1, 2, 500, rng.randrange(1000)]), n, rng.choice([None, rng.randrange(50)])) for n in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int, n int, v int")
    want, sums, tops = {}, defaultdict(lambda: None), defaultdict(lambda: None)
    for k, t, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            sums[k], tops[k] = (sums[k] or 0) + v, max(tops[k] if tops[k] is not None else v, v)
        want[n] = (sums[k], tops[k])
    dealt = scan.with_ranges(df, "t", 100)
    assert dealt.select("__range").distinct().count() > 3
    got = scan.running(df, ["k"], "t", ["n"], {"s": F.col("v").cast("long")}, {"m": F.col("v")}, 100)
    assert {r.n: (r.s, r.m) for r in got.collect()} == want


def test_key_order_against_sorted_lists(spark, tmp_path):
    rng = random.Random(4)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for case, files in enumerate([
            [[(i, "a") for i in range(40)], [(i, "a") for i in range(40, 60)]], [[(1, "a"), (1, "b"), (2, None)], [(2, "a")]], [[(i, "x") for i in range(7)] + [(6, "x"), (8, "x")]],
            [[(i, "x") for i in range(10)], [(9, "x"), (11, "y")]], [[(rng.randrange(9), rng.choice("abé")) for _ in range(50)]], [[(None, "a"), (1, "a"), (2, "a")]],
        ]):
            for part in files:
                spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{case}")
            rows = spark.read.parquet(f"{tmp_path}/{case}")
            every = [r for part in files for r in part]
            low = lambda r: tuple((x is not None, x) for x in r) if None not in r else tuple((x is not None, x or "" if i else x or 0) for i, x in enumerate(r))
            found = artifacts.key_order(rows, ("k", "v")).first()
            assert (found.n, found.null_keys) == (len(every), sum(None in r for r in every))
            assert found.unordered == sum(low(a) > low(b) for part in files for a, b in zip(part, part[1:]))
            assert artifacts.distinct_keys(rows, ("k", "v")) == len(set(every)) and (found.unproven > 0 or len(set(every)) == len(every))
            bad = artifacts.violations(rows, "a", Contract(("k", "v"), "k int, v string"), len(every)).first()
            assert bad.missing_rows == 0 and bad.repeated_keys == sum(every.count(r) > 1 for r in set(every))
        assert artifacts.key_order(spark.read.parquet(f"{tmp_path}/0"), ("k", "v")).first().unproven == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
