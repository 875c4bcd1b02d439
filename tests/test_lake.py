from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelspark.sources import lake
from panelspark.sources.lake import consolidated_industries, file_years, normalized, revisions

SCHEMA = "year int, id int, v string"


def rows(df):
    return sorted((r.year, r.id, r.v) for r in df.collect())


def test_publish_read_and_upsert(spark, tmp_path):
    path = f"{tmp_path}/d"
    df = spark.createDataFrame([(2020, 1, "a"), (2020, 2, None), (2021, 1, "c")], SCHEMA)
    for _ in range(2):  # once more leaves the same table
        lake.publish(df, path, "year", ["id"])
        assert rows(lake.read(spark, path)) == [(2020, 1, "a"), (2020, 2, None), (2021, 1, "c")]
    assert lake.read(spark, path, ["v"], F.col("year") == 2021).collect()[0].v == "c"
    plan = lake.read(spark, path, ["v"], (F.col("year") == 2021) & (F.col("id") == 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(id,1)" in plan
    before = {r.partition_value: r for r in lake.partition_hashes(lake.read(spark, path), "year").collect()}
    lake.upsert(spark.createDataFrame([(2021, 1, "new"), (2021, 5, "e"), (2022, 1, "z")], SCHEMA), path, "year", ["id"])
    assert rows(lake.read(spark, path)) == [(2020, 1, "a"), (2020, 2, None), (2021, 1, "new"), (2021, 5, "e"), (2022, 1, "z")]
    now = lake.partition_hashes(lake.read(spark, path), "year")
    recorded = spark.createDataFrame(list(before.values()), now.schema)
    found = {r.partition_value: r.status for r in lake.changed_partitions(now.where("partition_value <> '2020'"), recorded).collect()}
    assert found == {"2020": "canonical_file_missing", "2021": "raw_input_changed", "2022": "new_partition"}
    assert {r.status for r in lake.changed_partitions(now, now).collect()} == {"unchanged"}
    with pytest.raises(ValueError, match="same"):
        lake.publish(df.union(df), path, "year", ["id"])


def test_catalog_hash_and_gate(spark):
    df = spark.createDataFrame([(2020, 1, "a"), (2020, 2, None), (2021, 1, "c")], SCHEMA)
    total = lambda d: tuple(lake.catalog_hash(lake.partition_hashes(d, "year").withColumn("dataset", F.lit("d"))).first())
    assert total(df) == total(df.orderBy("v").repartition(3)) != total(df.withColumn("v", F.coalesce("v", F.lit("-"))))
    results = spark.createDataFrame([("a", "PASS", False), ("a", "FAIL", False), ("b", "FAIL", True), ("c", "PASS", None)], "dataset string, status string, blocks boolean")
    assert {r.dataset: r.open for r in lake.open_gates(results).collect()} == {"a": True, "b": False, "c": False}


def test_normalize_revisions_and_industries(spark, tmp_path):
    raw = spark.createDataFrame([(" 000001.SZ ", "20240102", "12", "x"), ("", "bad", "", "1.5")], "ts_code string, d string, vol string, amt string")
    rows = normalized(raw, {"ts_code": "id", "d": "trade_date", "vol": "volume", "amt": "amount"}, {"trade_date": "date", "volume": "double", "amount": "double"}, {"volume": 100.0}).collect()
    assert tuple(rows[0]) == ("000001.SZ", date(2024, 1, 2), 1200.0, None) and tuple(rows[1]) == (None, None, None, 1.5)
    r = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "k string, t int, v string")
    assert [(x.t, x.revision) for x in revisions(r, ["k"], ["t"]).orderBy("t").collect()] == [(1, 0), (3, 1)]
    m = spark.createDataFrame([("A", "c", date(2020, 1, 1), None, datetime(2020, 1, 2), "old"), ("A", "c", date(2020, 1, 1), date(2021, 1, 1), datetime(2021, 1, 3), "new")], "instrument_id string, code string, in_date date, out_date date, available_at timestamp_ntz, name string")
    x = consolidated_industries(m).first()
    assert (x.name, x.in_available_at, x.out_available_at) == ("new", datetime(2020, 1, 2), datetime(2021, 1, 3))
    r.withColumn("d", F.lit("2024-01-01").cast("date")).coalesce(1).write.parquet(f"{tmp_path}/f")
    assert file_years(spark, f"{tmp_path}/f", "d").first().years == [2024]
