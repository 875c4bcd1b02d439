from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import streaming
from panelspark.operators import selection, strategies
from panelspark.sources import artifacts, lake, pages

SCHEMA = "year int, id int, v string"


def rows(spark, path):
    return sorted((r.year, r.id, r.v) for r in lake.read(spark, path).collect())


def test_a_publish_that_dies_midway_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/d"
    lake.publish(spark.createDataFrame([(y, i, "old") for y in (2019, 2020, 2021) for i in range(5)], SCHEMA), path, "year", ["id"])
    before = rows(spark, path)
    new = spark.createDataFrame([(y, i, "new") for y in (2020, 2021, 2022) for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="lost"):
        lake.publish(new.withColumn("v", F.when(F.col("year") == 2022, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), path, "year", ["id"])
    assert rows(spark, path) == before
    with pytest.raises(ValueError, match="same"):
        lake.publish(new.union(new.limit(1)), path, "year", ["id"])
    assert rows(spark, path) == before
    moved, done = artifacts.move, []

    def breaks(s, a, b):
        done.append(a)
        if len(done) == 4:  # in the middle of the second partition
            raise OSError("gone")
        moved(s, a, b)

    monkeypatch.setattr(artifacts, "move", breaks)
    with pytest.raises(OSError, match="gone"):
        lake.publish(new, path, "year", ["id"])
    monkeypatch.setattr(artifacts, "move", moved)
    assert rows(spark, path) == before
    lake.publish(new, path, "year", ["id"])
    assert rows(spark, path) == sorted([r for r in before if r[0] == 2019] + [(y, i, "new") for y in (2020, 2021, 2022) for i in range(3)])
    assert [p.name for p in tmp_path.iterdir()] == ["d"]


def test_raw_tables_keep_strings_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(2020, 1, None), (2020, 1, None), (2021, 2, " x ")], SCHEMA)
    lake.publish_raw(df, f"{tmp_path}/raw", "year")
    back = spark.read.schema("year string, id string, v string").parquet(f"{tmp_path}/raw")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.select(*[F.col(c).cast("string") for c in df.columns]).collect()))
    lake.publish(df.limit(0), f"{tmp_path}/raw", "year")
    assert back.count() == 3


def test_pages_read_their_files_alone(spark, tmp_path):
    rng = random.Random(1)
    ids = list(range(5000))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, i % 7, f"t{i}") for i in ids], "id int, kind int, t string").repartition(6)
    path = f"{tmp_path}/p"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_sorted(df, path, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 8
    for where, fits in ((None, ids), (F.col("kind") == 3, [i for i in ids if i % 7 == 3])):
        fits = sorted(fits)
        for number, size in ((1, 10), (3, 333), (25, 200), (700, 10)):
            got, total = pages.page(spark, path, number, size, where)
            assert total == len(fits)
            want = fits[(number - 1) * size : number * size]
            assert [(r.id, r.row_number) for r in got.orderBy("row_number").collect()] == [(i, (number - 1) * size + k + 1) for k, i in enumerate(want)]
            if want and size == 10:
                assert len(got.inputFiles()) <= 2
    none, total = pages.page(spark, path, 1, 5, F.col("kind") == 99)
    assert total == 0 and none.count() == 0
    with pytest.raises(ValueError):
        pages.page(spark, path, 0, 5)


def test_exact_percentiles_of_hot_groups(spark):
    rng = random.Random(2)
    values = {"even": [rng.random() for _ in range(3000)], "wild": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(1500)], "tied": [1.0] * 900 + [2.0] * 5, "one": [7.5], "none": [None, float("nan")], None: [3.0, 1.0, float("inf")], "pair": [-1.7e308, 1.7e308]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    points = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for few, grid in ((60, 32), (10_000, 256)):
        got = {r.k: r for r in selection.exact_percentiles(df, ["k"], "v", points, few, grid).collect()}
        assert set(got) == set(values)
        for k, vs in values.items():
            x = np.array([v for v in vs if v is not None and np.isfinite(v)])
            for name, p in points.items():
                if not len(x):
                    assert got[k][name] is None
                elif k == "pair":  # between them lies more than a double's range
                    assert p not in (0.0, 1.0) or got[k][name] == vs[int(p)]
                else:
                    assert got[k][name] == pytest.approx(np.percentile(x, p * 100), rel=1e-12)
    assert selection.exact_percentiles(df.limit(0), ["k"], "v", points).count() == 0
    assert selection.exact_percentiles(df.where("k = 'even'"), [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(values["even"]))


def test_late_and_repeated_rows_end_in_the_same_table(spark, tmp_path):
    rng = random.Random(3)
    t0 = datetime(2024, 3, 1)
    events = [(i, t0 + timedelta(hours=rng.randrange(24 * 20)), float(rng.randrange(100))) for i in range(400)]
    order = sorted(events, key=lambda e: e[1] + timedelta(days=rng.choice([0, 0, 1, 4])))
    parts = [order[a : a + 100] + rng.sample(events[:200], 5) for a in range(0, 400, 100)]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "event_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = streaming.rebuilt(spark, f"{tmp_path}/in", f"{tmp_path}/out", overlap_days=60)
    want = {}
    for i, ts, v in {e[0]: e for e in events}.values():
        n, s = want.get(ts.date(), (0, 0.0))
        want[ts.date()] = (n + 1, s + v)
    assert {r.day: (r.n_events, r.total) for r in out.collect()} == want
    assert streaming.newest_day(spark, f"{tmp_path}/out") == max(want)
    # another file of a closed day, and one that was there before
    spark.createDataFrame([(900, t0, 1.0), (901, t0 + timedelta(days=19), 5.0), (events[0][0], events[0][1], events[0][2])], "event_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = {r.day: r.n_events for r in streaming.rebuilt(spark, f"{tmp_path}/in", f"{tmp_path}/out", overlap_days=2).collect()}
    n = lambda d: want.get(d, (0, 0))[0]
    last = (t0 + timedelta(days=19)).date()
    assert again[last] == n(last) + 1 and again.get(t0.date(), 0) == n(t0.date())
    assert 900 in {r.event_id for r in spark.read.parquet(f"{tmp_path}/out/late").collect()}


def test_strategies_are_checked_when_they_are_composed(spark):
    catalog = strategies.Catalog(strategies.STANDARD)
    frame = spark.createDataFrame([(1, "A", 1.0, 9.0, 0.0, "x", 10), (1, "B", 2.0, 9.0, 0.5, "x", 10), (1, "C", None, 9.0, 0.0, "y", 0)], "signal_date int, instrument_id string, s double, adv_amount double, current_weight double, industry string, equity_cents long")

    class Own:
        name = "own"
        parts = [("alpha", "column", {"column": "s"}), ("construction", "equal_weight", {"n": 2, "cap": 0.5, "least_adv": 1.0}), ("constraint", "industry_cap", {"cap": 0.6}), ("constraint", "name_cap", {"cap": 0.25}), ("cost", "fixed_linear", {"commission_bps": 10.0, "minimum_cents": 0})]

        def candidates(self, inputs):
            return inputs["all"]

    got = {r.instrument_id: r for r in strategies.composed(Own(), catalog, {"all": frame}).collect()}
    assert {k: round(r.target_weight, 9) for k, r in got.items()} == {"A": 0.25, "B": 0.25, "C": 0.0}
    assert got["B"].expected_cost == pytest.approx(0.25 * 0.001) and got["C"].expected_cost == 0.0 and got["A"].strategy == "own"
    bad = Own()
    for parts, error, match in (
        ([("alpha", "other", {})], ValueError, "one construction"),
        ([("alpha", "other", {}), Own.parts[1]], KeyError, "no alpha"),
        ([("alpha", "column", {"col": "s"}), Own.parts[1]], ValueError, "argument"),
        ([("alpha", "dual_ma", {"short": 1, "long": 2}), Own.parts[1]], ValueError, "close"),
        ([Own.parts[1], Own.parts[0]], ValueError, "then constraints"),
    ):
        bad.parts = parts
        with pytest.raises(error, match=match):
            strategies.composed(bad, catalog, {"all": frame})
    with pytest.raises(ValueError):
        catalog.register(strategies.STANDARD[0])
