"""Queries of constructors, corporate actions and streams (B2, B5, B7, D7, L2, L4-L6) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark import streaming
from panelspark.operators import actions, decisions, performance, portfolio, quality, review, study
from panelspark.plans.decisions import _candidates
from panelspark.plans.study import rounded
from panelspark.plans.tables import BARS, PANEL, bars, factor, factor_sql, factors, load, panel, query, shared_folder
from panelspark.sources import lake


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.drained(spark, f"{sf_dir}/events.parque[t]", shared_folder(spark, "stream"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.sessions(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("instrument_id"), F.trunc(day, "quarter").alias("report_period"), day.alias("record_date"), F.date_add(day, 1).alias("ex_date"), F.date_add(day, 5).alias("pay_date"), F.date_add(day, 3).alias("listing_date"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 12).cast("int"))).alias("available_at"), k.alias("revision"), F.when(F.col("o_orderstatus") == "P", "PLANNED").otherwise("IMPLEMENTED").alias("status"), F.lit(True).alias("pit_usable"),
        ((k % 50) / F.lit(64.0)).alias("cash_per_share"), ((k % 8) / F.lit(16.0)).alias("stock_per_share"),
    )


_EVENTS = """ev AS (SELECT o_custkey % 100 AS instrument_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_period, CAST(o_orderdate AS DATE) AS record_date, o_orderdate + INTERVAL (o_orderkey % 12) HOUR AS available_at, o_orderkey AS revision, (o_orderkey % 50) / 64.0::DOUBLE AS cash_per_share, (o_orderkey % 8) / 16.0::DOUBLE AS stock_per_share, o_orderstatus FROM orders),
known AS (SELECT * FROM ev WHERE o_orderstatus <> 'P' AND record_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND available_at <= CAST(record_date AS TIMESTAMP) + INTERVAL 7 HOUR QUALIFY row_number() OVER (PARTITION BY instrument_id, report_period ORDER BY available_at DESC, revision DESC) = 1)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.dividend_events(_events(spark, sf_dir), F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))


@query(f"WITH {_EVENTS} SELECT instrument_id, report_period, record_date, available_at, revision, cash_per_share, stock_per_share FROM known")
def dividend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("instrument_id", "report_period", "record_date", "available_at", "revision", "cash_per_share", "stock_per_share")


_OPEN = "open_ AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 1 AND dayofweek(l_shipdate) BETWEEN 1 AND 5)"


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(day.alias("trade_date")).distinct().withColumn("is_trading_day", F.dayofweek("trade_date").between(2, 6))


@query(f"WITH {_EVENTS}, {_OPEN} SELECT k.instrument_id, k.record_date, k.revision, (SELECT min(d) FROM open_ WHERE d >= k.record_date) AS record_session, (SELECT min(d) FROM open_ WHERE d >= k.record_date + 1) AS ex_session FROM known k")
def mapped_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = actions.mapped_to_sessions(_known(spark, sf_dir), _calendar(spark, sf_dir), {"record_date": "record_session", "ex_date": "ex_session"})
    return out.select("instrument_id", "record_date", "revision", "record_session", "ex_session")


@query(f"WITH {_OPEN} SELECT d AS trade_date, lead(d) OVER (ORDER BY d) AS next_session FROM open_")
def next_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.next_session(_calendar(spark, sf_dir))


@query(
    f"""WITH {_EVENTS}, h AS (SELECT l_linenumber AS run_id, CAST(l_shipdate AS DATE) AS record_date, l_suppkey AS instrument_id, CAST(sum(l_quantity) AS BIGINT) * 7 AS quantity FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(run_id AS INTEGER) AS run_id, instrument_id, record_date, quantity, CAST(round(CAST(quantity AS DECIMAL(18, 0)) * CAST(cash_per_share AS DECIMAL(18, 8)) * 100, 0) AS BIGINT) AS cash_cents, CAST(floor(quantity * stock_per_share) AS BIGINT) AS new_shares FROM known JOIN h USING (instrument_id, record_date)"""
)
def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run_id"), F.col("l_shipdate").cast("date").alias("trade_date"), F.col("l_suppkey").alias("instrument_id")).agg((F.sum("l_quantity").cast("long") * 7).alias("quantity"))
    none = spark.createDataFrame([], "instrument_id long, trade_date date, split_ratio double, relative_error double")
    return actions.entitlements(actions.assembled_actions(_known(spark, sf_dir), none), held).select("run_id", "instrument_id", "record_date", "quantity", "cash_cents", "new_shares")


@query()
def optimized_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each month; covariances of those alone that are ever among them."""
    c = _candidates(spark, sf_dir).withColumn("capacity_limit", F.col("adv_amount") / 1e6)
    best = Window.partitionBy("signal_date").orderBy(F.col("score").desc(), "instrument_id")
    ever = c.where("score is not null").withColumn("n", F.row_number().over(best)).where("n <= 10").select("instrument_id").distinct()
    cov = decisions.shrunk_covariance(panel(spark, sf_dir).join(ever, "instrument_id", "left_semi").withColumnRenamed("log_return", "r"))
    return portfolio.alpha_risk_cost(c, cov, 10, 0.2, most_turnover=0.6)


@query()
def assembled_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).withColumn("current_weight", F.when(F.col("instrument_id") < 8, 0.1).otherwise(0.0))
    return portfolio.assembled(c, 10, 0.12, 0.3, 0.4)


@query(f"WITH {BARS} SELECT l_suppkey % 10 AS decile, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT instrument_id FROM bars WHERE amount > 100000) GROUP BY 1")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a computed set (P3) as a left-semi join."""
    ids = bars(spark, sf_dir).where("amount > 100000").select(F.col("instrument_id").alias("l_suppkey")).distinct()
    return load(spark, sf_dir, "lineitem").join(ids, "l_suppkey", "left_semi").groupBy((F.col("l_suppkey") % 10).alias("decile")).agg(F.count("*").alias("n"))


_WARNED = "warned AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS signal_date, l_suppkey AS instrument_id FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R')"


def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return load(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_returnflag = 'R'").select(month.alias("signal_date"), F.col("l_suppkey").alias("instrument_id")).distinct()


@query(
    f"""WITH {BARS}, {_WARNED} SELECT d.signal_date, s.s_suppkey AS instrument_id, w.instrument_id IS NULL AS eligible, CASE WHEN w.instrument_id IS NULL THEN '' WHEN w.instrument_id % 2 = 0 THEN 'RISK_WARNING,SUSPENDED' ELSE 'RISK_WARNING' END AS reasons
FROM supplier s CROSS JOIN (SELECT DISTINCT trade_date AS signal_date FROM bars) d LEFT JOIN warned w ON w.signal_date = d.signal_date AND w.instrument_id = s.s_suppkey"""
)
def strategy_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = _warned(spark, sf_dir).withColumns({"is_risk_warning": F.lit(True), "is_suspended": F.col("instrument_id") % 2 == 0})
    instruments = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id"))
    out = decisions.strategy_universe(instruments, bars(spark, sf_dir).select(F.col("trade_date").alias("signal_date")).distinct(), statuses)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH {BARS}, o AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM bars)), b AS (SELECT b.*, o.n FROM bars b JOIN o USING (trade_date)),
m AS (SELECT *, CASE WHEN count(*) OVER s = 3 THEN avg(close) OVER s END AS x, CASE WHEN count(*) OVER l = 8 THEN avg(close) OVER l END AS y, coalesce(n - lag(n, 7) OVER (PARTITION BY instrument_id ORDER BY trade_date) = 7, false) AS whole FROM b WINDOW s AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 2 PRECEDING), l AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 7 PRECEDING)),
d AS (SELECT *, CASE WHEN whole AND x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN x > y THEN 'LONG' ELSE 'FLAT' END END AS direction FROM m), p AS (SELECT *, coalesce(last_value(direction IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'FLAT') AS before FROM d)
SELECT instrument_id, trade_date AS signal_date, direction, CASE WHEN direction = 'LONG' AND before = 'FLAT' THEN 'ENTER' WHEN direction = 'FLAT' AND before = 'LONG' THEN 'EXIT' ELSE 'HOLD' END AS action, CASE WHEN direction IS NULL THEN 'INSUFFICIENT_CONTIGUOUS_WINDOW' END AS invalid_reason FROM p"""
)
def dual_ma_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    ordinals = b.select("trade_date").distinct().withColumn("session_ordinal", F.row_number().over(Window.orderBy("trade_date")))  # a calendar
    return decisions.dual_ma_strategy(b, ordinals, 3, 8)


@query(
    """WITH s AS (SELECT c_nationkey AS portfolio_id, o_custkey AS security, CAST(sum(CAST(round(o_totalprice) AS BIGINT) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS BIGINT) AS contribution FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY abs(contribution) DESC, security) AS INTEGER) AS place FROM s"""
)
def attribution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("portfolio_id"), F.col("c_custkey").alias("o_custkey"))
    signed = F.round("o_totalprice").cast("long") * F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    return performance.attribution_rollup(load(spark, sf_dir, "orders").join(c, "o_custkey").select("portfolio_id", F.col("o_custkey").alias("security"), signed.alias("contribution")))


@query(
    """SELECT n_nationkey AS k, n_name, CAST(m.n AS BIGINT) AS n_suppliers, coalesce(d.decision, 'PENDING') AS decision FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) m ON m.s_nationkey = n_nationkey
LEFT JOIN (SELECT n_nationkey AS k, 'KEEP' AS decision FROM nation WHERE n_nationkey % 3 = 0) d ON d.k = n_nationkey"""
)
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    metrics = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return performance.decision_matrix(nation, metrics, nation.where("k % 3 = 0").select("k", F.lit("KEEP").alias("decision")), ["k"])


@query(
    f"""WITH {BARS}, {_WARNED}, c AS (SELECT s_suppkey AS instrument_id, trade_date FROM supplier CROSS JOIN (SELECT DISTINCT trade_date FROM bars))
SELECT c.trade_date, count(*) AS listed, count(*) FILTER (WHERE w.instrument_id IS NULL) AS reviewed, count(*) FILTER (WHERE w.instrument_id IS NULL AND b.close > 0) AS priced, round(count(*) FILTER (WHERE w.instrument_id IS NULL AND b.close > 0) / count(*) FILTER (WHERE w.instrument_id IS NULL), 9) AS coverage
FROM c LEFT JOIN warned w ON w.signal_date = c.trade_date AND w.instrument_id = c.instrument_id LEFT JOIN bars b ON b.trade_date = c.trade_date AND b.instrument_id = c.instrument_id GROUP BY 1"""
)
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    listed = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id")).crossJoin(F.broadcast(b.select("trade_date").distinct()))  # sessions: a calendar
    return rounded(review.day_coverage(listed, _warned(spark, sf_dir).withColumnRenamed("signal_date", "trade_date"), b), 9)


@query(
    f"""WITH {PANEL}{factor_sql(6)}, u AS (SELECT signal_date, instrument_id FROM factor WHERE instrument_id % 4 <> 0), i AS (SELECT *, CASE WHEN instrument_id % 9 = 0 THEN ' ' ELSE 'n' || CAST(instrument_id % 5 AS VARCHAR) END AS industry, instrument_id % 10 = 0 AS ended FROM u WHERE instrument_id % 7 <> 0)
SELECT u.signal_date, count(*) AS eligible_count, count(*) FILTER (WHERE trim(industry) <> '' AND NOT ended) AS classified, count(*) FILTER (WHERE ended) AS ended, count(*) FILTER (WHERE coalesce(trim(industry), '') = '' AND NOT coalesce(ended, false)) AS missing,
round(count(*) FILTER (WHERE trim(industry) <> '' AND NOT ended) / count(*), 9) AS usable_share FROM u LEFT JOIN i USING (signal_date, instrument_id) GROUP BY 1"""
)
def industry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return industry_rows(factor(spark, sf_dir))


def industry_rows(f: DataFrame) -> DataFrame:
    i = F.col("instrument_id")
    cells = f.select("signal_date", "instrument_id", (i % 4 != 0).alias("eligible"))
    known = cells.where(i % 7 != 0).select(F.col("signal_date").alias("date"), "instrument_id", F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("n"), (i % 5).cast("string"))).alias("industry"), (i % 10 == 0).alias("ended"))
    return rounded(study.industry_coverage(cells, known), 9)


@query(f"WITH {PANEL}{factor_sql(6)}{factor_sql(3, 'factor3')}, a AS (SELECT * FROM factor UNION ALL SELECT * FROM factor3) SELECT signal_date, instrument_id, factor_id, value * CASE factor_id WHEN 'return_3m' THEN -1 ELSE 1 END AS value, 'direction_adjusted' AS signal_variant FROM a UNION ALL SELECT signal_date, instrument_id, factor_id, value / 2, 'neutralized' FROM factor")
def signal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = factors(spark, sf_dir, 6, 3)
    directions = spark.createDataFrame([("return_6m", 1), ("return_3m", -1)], "factor_id string, direction int")
    out = study.signal_variants(both, directions, both.where("factor_id = 'return_6m'").withColumn("value", F.col("value") / 2))
    return out.select("signal_date", "instrument_id", "factor_id", "value", "signal_variant")


_HOLDINGS = """h AS (SELECT s_nationkey AS portfolio_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS trade_date, l_suppkey AS security, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS market_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
nav AS (SELECT portfolio_id, trade_date, CAST(portfolio_id AS BIGINT) * 10 AS cash, CAST(sum(market_value) AS BIGINT) + portfolio_id * 10 AS equity FROM h GROUP BY 1, 2)"""


@query(
    f"""WITH {_HOLDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id, trade_date ORDER BY abs(market_value) DESC, security) AS n FROM h), b AS (SELECT portfolio_id, trade_date, CASE WHEN n <= 3 THEN CAST(security AS VARCHAR) ELSE 'OTHER' END AS bucket, CAST(sum(market_value) AS BIGINT) AS market_value FROM r GROUP BY 1, 2, 3
UNION ALL SELECT portfolio_id, trade_date, 'CASH', cash FROM nav) SELECT b.portfolio_id, b.trade_date, bucket, market_value, equity, round(market_value / equity, 9) AS weight FROM b JOIN nav USING (portfolio_id, trade_date)"""
)
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("portfolio_id"))
    year = F.trunc(F.col("l_shipdate").cast("date"), "year")
    held = load(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("portfolio_id", year.alias("trade_date"), F.col("l_suppkey").alias("security")).agg(F.sum(F.col("l_quantity").cast("long")).alias("market_value"))
    cash = F.col("portfolio_id").cast("long") * 10
    nav = held.groupBy("portfolio_id", "trade_date").agg(F.sum("market_value").alias("m")).select("portfolio_id", "trade_date", cash.alias("cash"), (F.col("m") + cash).alias("equity"))
    return rounded(performance.exposures(held, nav, 3), 9)


@query(
    """WITH e AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS record_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS ex_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS pay_date, o_orderdate + INTERVAL (o_orderkey % 20) HOUR AS available_at,
  CASE WHEN o_orderkey % 9 = 0 THEN -0.1 ELSE 0.5 END AS cash, 0.25 AS bonus, CASE WHEN o_orderkey % 4 = 0 THEN 0.3 ELSE 0.25 END AS stock, o_orderstatus <> 'P' AS done FROM orders)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE cash < 0) AS amounts, 0::BIGINT AS dates_missing, count(*) FILTER (WHERE done AND available_at > CAST(record_date AS TIMESTAMP) + INTERVAL 15 HOUR) AS seen_too_late, count(*) FILTER (WHERE record_date >= ex_date OR pay_date < ex_date) AS date_order, count(*) FILTER (WHERE abs(stock - bonus) > 1e-12) AS stock_parts FROM e"""
)
def dividend_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = load(spark, sf_dir, "orders").select(
        day.alias("record_date"), F.date_add(day, (k % 3).cast("int")).alias("ex_date"), F.date_add(day, (k % 5).cast("int")).alias("pay_date"), F.lit(None).cast("date").alias("listing_date"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 20).cast("int"))).alias("available_at"), F.when(k % 9 == 0, -0.1).otherwise(0.5).alias("cash_per_share"), F.lit(0.25).alias("bonus_per_share"),
        F.lit(None).cast("double").alias("conversion_per_share"), F.when(k % 4 == 0, 0.3).otherwise(0.25).alias("stock_per_share"), F.when(F.col("o_orderstatus") == "P", "PLANNED").otherwise("IMPLEMENTED").alias("status"),
    )
    return quality.counts(rows, quality.dividend_violations())


@query(
    """WITH e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) - 1 AS p, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 40 AS INTEGER) AS a, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS i, CAST(o_orderdate AS DATE) - 5 + CAST(o_orderkey % 10 AS INTEGER) AS o, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) END AS oa FROM orders)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE month(p) % 3 <> 0 OR a < p) AS financial, count(*) FILTER (WHERE i IS NULL OR o < i OR oa IS NULL) AS industry FROM e"""
)
def state_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    begun = F.when(k % 6 != 0, day)
    rows = load(spark, sf_dir, "orders").select(
        F.date_sub(F.trunc(day, "month"), 1).alias("report_period"), F.date_sub(day, (k % 40).cast("int")).alias("announcement_date"), begun.alias("in_date"), begun.alias("in_available_at"),
        F.date_add(F.date_sub(day, 5), (k % 10).cast("int")).alias("out_date"), F.when(k % 8 != 0, day).alias("out_available_at"),
    )
    return quality.counts(rows, {"financial": quality.financial_violations(), "industry": quality.industry_violations()})


_MONTHS = "CAST(date_trunc('month', o_orderdate) AS DATE)"


@query(
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'C' || o_custkey END AS instrument_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS trade_date, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) * 100 END AS volume FROM orders"""
)
def normalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of strings renamed, trimmed, cast and scaled."""
    k, text = F.col("o_orderkey"), lambda c: F.concat(F.lit("  "), c.cast("string"), F.lit(" "))
    raw = load(spark, sf_dir, "orders").select(
        text(k).alias("no"), F.when(k % 9 != 0, F.concat(F.lit(" C"), F.col("o_custkey").cast("string"))).otherwise("   ").alias("ts_code"),
        F.when(k % 7 != 0, F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd")).otherwise("bad").alias("day"), F.when(k % 5 != 0, text(F.col("o_custkey"))).otherwise("n/a").alias("vol"),
    )
    return lake.normalized(raw, {"no": "row_id", "ts_code": "instrument_id", "day": "trade_date", "vol": "volume"}, {"row_id": "bigint", "trade_date": "date", "volume": "double"}, {"volume": 100.0})


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority AS content, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS revision FROM r WHERE n = 1"""
)
def row_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content without repeats, numbered within its key."""
    return lake.revisions(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("content")), ["o_custkey"], ["o_orderkey"])


_SEEN = """seen AS (SELECT o_custkey AS instrument_id, o_orderpriority AS code, CAST(date_trunc('year', o_orderdate) AS DATE) AS in_date, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS out_date, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 86400) SECOND AS available_at, o_orderkey AS name FROM orders)"""


@query(
    f"""WITH {_SEEN}, t AS (SELECT instrument_id, code, in_date, min(available_at) AS in_available_at, min(available_at) FILTER (WHERE out_date IS NOT NULL) AS out_available_at FROM seen GROUP BY 1, 2, 3)
SELECT s.*, t.in_available_at, t.out_available_at FROM (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY instrument_id, code, in_date ORDER BY available_at DESC) = 1) s JOIN t USING (instrument_id, code, in_date)"""
)
def industry_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per membership with its first entry and exit times."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, CAST(o_orderkey % 86400 AS INT))")
    seen = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderpriority").alias("code"), F.trunc(day, "year").alias("in_date"), F.when(k % 3 == 0, day).alias("out_date"), at.alias("available_at"), k.alias("name"))
    return lake.consolidated_industries(seen)


@query(
    f"""WITH a AS (SELECT {_MONTHS} AS m, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS c FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1), b AS (SELECT {_MONTHS} AS m FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1)
SELECT CAST(coalesce(a.m, b.m) AS VARCHAR) AS partition_value, CASE WHEN b.m IS NULL THEN 'new_partition' WHEN a.m IS NULL THEN 'canonical_file_missing' WHEN a.c > 0 THEN 'raw_input_changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.m = b.m"""
)
def changed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders against an earlier state (N3): every fiftieth order's customer has changed since."""
    o = load(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_orderkey", "o_custkey", "o_orderdate")
    now = o.where("o_orderdate >= '1996-01-01'").withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0))
    return lake.changed_partitions(lake.partition_hashes(now.drop("o_orderdate"), "month"), lake.partition_hashes(o.where("o_orderdate < '1998-01-01'").drop("o_orderdate"), "month"))


@query(
    """SELECT CAST(c_nationkey AS VARCHAR) AS dataset, NOT bool_or(c_acctbal < -950) AS open FROM customer GROUP BY 1"""
)
def open_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations' customers passed validation."""
    bad = F.col("c_acctbal") < -950
    return lake.open_gates(load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("dataset"), F.when(bad, "FAIL").otherwise("PASS").alias("status"), bad.alias("blocks")))


@query(f"WITH {BARS}, e AS (SELECT trade_date AS signal_date, md5(length(CAST(instrument_id AS VARCHAR)) || ':' || instrument_id || '|10:' || trade_date) AS m FROM bars WHERE amount > 100000) SELECT signal_date, count(*) AS n_rows, bit_xor(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS xor_hash, CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT) % 2147483647) AS BIGINT) AS sum_hash FROM e GROUP BY 1")
def universe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each month's universe, the names traded above a floor."""
    rows = bars(spark, sf_dir).select(F.col("trade_date").alias("signal_date"), "instrument_id", (F.col("amount") > 100000).alias("eligible"))
    return decisions.universe_identity(rows)
