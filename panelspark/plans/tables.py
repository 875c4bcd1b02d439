"""The engine's inputs read off the sample tables, in Spark and in SQL.

Instruments are suppliers and sessions are months of shipment: a supplier's bar of a
month has as close its mean price per unit. Money is summed in whole cents, so that
both engines compute on the same numbers.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local one; on a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/panelspark/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there, for several tables that are made of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, trade_date, open, high, low, close, amount, volume."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cents, units = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("instrument_id"), month.alias("trade_date")).agg(
        ((F.min(unit) + F.max(unit)) / 2).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum(cents) / (F.sum(units) * F.lit(100.0))).alias("close"), (F.sum(cents) / F.lit(100.0)).alias("amount"), F.sum(units).cast("double").alias("volume"),
    )


BARS = """bars AS (
  SELECT l_suppkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
         (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / (sum(CAST(l_quantity AS BIGINT))::DOUBLE * 100.0::DOUBLE) AS close,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE AS amount, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS volume
  FROM lineitem GROUP BY 1, 2)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with preclose and log_return over each instrument's own rows."""
    return returns_of(bars(spark, sf_dir))


def returns_of(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = b.withColumn("preclose", F.lag("close").over(w))
    return rows.withColumn("log_return", F.ln("close") - F.ln("preclose"))


RETURNS = BARS + """, ret AS (
  SELECT *, ln(close) - ln(preclose) AS log_return FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS preclose FROM bars))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-complete log returns with their availability."""
    return panel_of(returns(spark, sf_dir))


def panel_of(r: DataFrame) -> DataFrame:
    from panelspark.operators.prices import session_grid

    cells = session_grid(r.select("instrument_id").distinct(), r.select("trade_date").distinct(), r, r.where("false"))
    return cells.withColumn("available_at", F.col("trade_date").cast("timestamp_ntz") + F.expr("INTERVAL 27 DAYS"))


PANEL = RETURNS + """, panel AS (
  SELECT i.instrument_id, d.trade_date, r.log_return, CAST(d.trade_date AS TIMESTAMP) + INTERVAL 27 DAY AS available_at
  FROM (SELECT DISTINCT instrument_id FROM bars) i CROSS JOIN (SELECT DISTINCT trade_date FROM bars) d
  LEFT JOIN ret r ON r.instrument_id = i.instrument_id AND r.trade_date = d.trade_date)"""


def factor(spark: SparkSession, sf_dir: str, months: int = 6) -> DataFrame:
    """A study's factor in long form: the return of the last months rows, rounded."""
    return factor_of(panel(spark, sf_dir), months)


def factor_of(cells: DataFrame, months: int) -> DataFrame:
    from panelspark.operators.factors import market_factor, period_return

    rows = market_factor(f"return_{months}m", period_return(months), months + 1)(cells)
    return rows.withColumn("value", F.round("value", 9))


def factors(spark: SparkSession, sf_dir: str, *months: int) -> DataFrame:
    """Several such factors, of one pass over the panel."""
    return factors_of(panel(spark, sf_dir), *months)


def factors_of(cells: DataFrame, *months: int) -> DataFrame:
    from panelspark.operators.factors import market_factors, period_return

    return market_factors({f"return_{m}m": (period_return(m), m + 1) for m in months})(cells).withColumn("value", F.round("value", 9))


def factor_sql(months: int = 6, name: str = "factor") -> str:
    return f""", {name} AS (
  SELECT trade_date AS signal_date, instrument_id, 'return_{months}m' AS factor_id, CASE WHEN n < {months + 1} OR v IS NULL THEN NULL ELSE round(v, 9) END AS value,
         n >= {months + 1} AND v IS NOT NULL AS is_valid,
         CASE WHEN n < {months + 1} THEN 'INSUFFICIENT_HISTORY' WHEN v IS NULL THEN 'NONFINITE_VALUE' END AS invalid_reason
  FROM (SELECT *, row_number() OVER o AS n, CASE WHEN count(log_return) OVER f = {months} THEN exp(sum(log_return) OVER f) - 1 END AS v FROM panel
        WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date), f AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN {months - 1} PRECEDING AND CURRENT ROW)))"""


def labels(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    return labels_of(panel(spark, sf_dir), bars(spark, sf_dir), horizons)


def labels_of(cells: DataFrame, b: DataFrame, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    from panelspark.operators.labels import forward_returns

    return forward_returns(cells.select(F.col("trade_date").alias("signal_date"), "instrument_id"), b.select("trade_date"), b, horizons)


def labels_sql(horizon: int = 1, name: str = "labels") -> str:
    return f""", cal_{name} AS (
  SELECT trade_date AS signal_date, lead(trade_date) OVER (ORDER BY trade_date) AS return_start, lead(trade_date, {horizon}) OVER (ORDER BY trade_date) AS return_end
  FROM (SELECT DISTINCT trade_date FROM bars)), {name} AS (
  SELECT p.trade_date AS signal_date, p.instrument_id, {horizon} AS horizon, 'theoretical' AS label_kind, c.return_start, c.return_end,
         CASE WHEN c.return_end IS NOT NULL THEN x.close / e.open - 1 END AS future_return,
         c.return_start IS NOT NULL AND c.return_end IS NOT NULL AND e.open IS NOT NULL AND x.close IS NOT NULL AS is_valid,
         CASE WHEN c.return_start IS NULL OR c.return_end IS NULL THEN 'INCOMPLETE_FORWARD_WINDOW' WHEN e.open IS NULL THEN 'MISSING_ENTRY_PRICE' WHEN x.close IS NULL THEN 'MISSING_EXIT_PRICE' END AS invalid_reason
  FROM panel p JOIN cal_{name} c ON c.signal_date = p.trade_date
  LEFT JOIN bars e ON e.instrument_id = p.instrument_id AND e.trade_date = c.return_start
  LEFT JOIN bars x ON x.instrument_id = p.instrument_id AND x.trade_date = c.return_end)"""
