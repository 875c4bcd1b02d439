"""Queries of composed strategies, pages, staged datasets, late data and exact percentiles (K5, S9, S10, S17, A11, A13) over the sample tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import streaming
from panelspark.operators import selection, strategies
from panelspark.plans.decisions import _EQUAL, _candidates
from panelspark.plans.tables import load, query, shared_folder
from panelspark.sources import lake, pages


class _Parts(NamedTuple):
    name: str
    parts: tuple[tuple[str, str, dict], ...]

    def candidates(self, inputs: dict[str, DataFrame]) -> DataFrame:
        return inputs["candidates"]


_MOMENTUM = _Parts("momentum", (("alpha", "column", {"column": "score"}), ("construction", "equal_weight", {"n": 15, "cap": 0.08, "least_adv": 100_000.0}), ("constraint", "industry_cap", {"cap": 0.2}), ("cost", "sqrt_impact", {"commission_bps": 2.5, "minimum_cents": 500, "impact_bps": 30.0})))
_TREND = _Parts("trend", (("alpha", "dual_ma", {"short": 3, "long": 8}), ("construction", "equal_weight", {"n": 10, "cap": 0.05, "least_adv": 50_000.0}), ("constraint", "name_cap", {"cap": 0.04}), ("cost", "linear_impact", {"commission_bps": 2.5, "minimum_cents": 500, "impact_bps": 30.0})))

_COST = "CASE WHEN abs(w - current_weight) > 0 THEN greatest(500.0::DOUBLE / 5000000, abs(w - current_weight) * {}) + sqrt(abs(w - current_weight)) * {} ELSE 0 END"


@query(
    f"""{_EQUAL}, i AS (SELECT *, target_weight * least(1.0::DOUBLE, coalesce(0.2::DOUBLE / nullif(sum(target_weight) OVER (PARTITION BY signal_date, industry), 0), 1)) AS w FROM target),
m AS (SELECT *, CASE WHEN count(*) OVER a = 3 THEN avg(price) OVER a END AS s, CASE WHEN count(*) OVER b = 8 THEN avg(price) OVER b END AS l FROM cand WINDOW a AS (PARTITION BY instrument_id ORDER BY signal_date ROWS 2 PRECEDING), b AS (PARTITION BY instrument_id ORDER BY signal_date ROWS 7 PRECEDING)),
f AS (SELECT *, coalesce(s > l, false) AND adv_amount >= 50000 AS fit FROM m), g AS (SELECT *, fit AND row_number() OVER (PARTITION BY signal_date ORDER BY fit DESC, instrument_id) <= 10 AS picked FROM f),
h AS (SELECT *, CASE WHEN picked THEN least(1.0::DOUBLE / count(*) FILTER (WHERE picked) OVER (PARTITION BY signal_date), 0.05) ELSE 0.0 END AS t FROM g), j AS (SELECT *, least(t, 0.04) AS w FROM h)
SELECT 'momentum' AS strategy, signal_date, instrument_id, round(w, 9) AS target_weight, round({_COST.format('0.00025::DOUBLE', '0.003::DOUBLE')}, 9) AS expected_cost FROM i
UNION ALL SELECT 'trend', signal_date, instrument_id, round(w, 9), round({_COST.format('0.00325::DOUBLE', '0.0::DOUBLE')}, 9) FROM j"""
)
def strategy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies made of catalogued parts, with what their trades are expected to cost (K5)."""
    catalog = strategies.Catalog(strategies.STANDARD)
    frame = {"candidates": _candidates(spark, sf_dir).withColumns({"close": F.col("price"), "equity_cents": F.lit(5_000_000).cast("long")})}
    out = [strategies.composed(s, catalog, frame).select("strategy", "signal_date", "instrument_id", F.round("target_weight", 9).alias("target_weight"), F.round("expected_cost", 9).alias("expected_cost")) for s in (_MOMENTUM, _TREND)]
    return out[0].unionByName(out[1])


@query("SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER w AS row_number, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (ORDER BY o_orderdate, o_orderkey) QUALIFY row_number() OVER w BETWEEN 301 AND 400")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the orders of one status, with their number."""
    path = shared_folder(spark, "pages")
    pages.write_sorted(load(spark, sf_dir, "orders"), path, ["o_orderdate", "o_orderkey"])
    rows, total = pages.page(spark, path, 4, 100, F.col("o_orderstatus") == "F")
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice", "row_number", F.lit(total).cast("long").alias("total"))


@query("SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS trade_date, o_totalprice * 100.0::DOUBLE AS amount, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderstatus = 'F'")
def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept raw as strings, corrected by a second delivery, made canonical by year and read back."""
    o = load(spark, sf_dir, "orders")
    raw = o.select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_totalprice").alias("p"), F.year("o_orderdate").alias("y"), "o_orderstatus")
    at = shared_folder(spark, "orders")
    wrong = F.col("id").cast("long") % 5 == 0
    first = raw.withColumn("p", F.when(wrong, F.lit("?")).otherwise(F.col("p").cast("string"))).where("cast(trim(id) as long) % 11 <> 0")
    lake.publish_raw(first.drop("o_orderstatus"), f"{at}/raw-1", "y")
    lake.publish_raw(raw.where(wrong | (F.col("id").cast("long") % 11 == 0)).where("cast(trim(id) as long) % 11 <> 0 or o_orderstatus = 'F'").drop("o_orderstatus"), f"{at}/raw-2", "y")
    for part in ("raw-1", "raw-2"):
        strings = spark.read.schema("id string, d string, p string, y string").parquet(f"{at}/{part}")
        typed = lake.normalized(strings, {"id": "order_id", "d": "trade_date", "p": "amount", "y": "year"}, {"order_id": "bigint", "trade_date": "date", "amount": "double", "year": "int"}, {"amount": 100.0})
        lake.upsert(typed, f"{at}/canonical", "year", ["order_id"])
    return lake.read(spark, f"{at}/canonical").select("order_id", "trade_date", "amount", "year")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in four files, out of order and with repeats, rebuilt day by day (late data)."""
    at = shared_folder(spark, "late")
    e = load(spark, sf_dir, "events").select("event_id", "ts", "value")
    for part in range(4):
        e.where((F.pmod(F.xxhash64("event_id"), F.lit(4)) == part) | (F.col("event_id") % 50 == 0)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    out = streaming.rebuilt(spark, f"{at}/in", f"{at}/out", overlap_days=400)
    return out.select("day", "n_events", F.round("total", 4).alias("total"))


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in (("p05", 0.05), ("p50", 0.5), ("p99", 0.99))) + " FROM lineitem GROUP BY 1")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of three groups that hold all lines."""
    out = selection.exact_percentiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p99": 0.99})
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p99")])
