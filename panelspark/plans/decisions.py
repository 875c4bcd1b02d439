"""Queries of universe, signals, portfolio, risk, cost, performance and data quality (U*, G*, B*, K*, V*, Q*) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import decisions as dec
from panelspark.operators import performance as perf
from panelspark.operators import quality
from panelspark.plans.study import rounded
from panelspark.plans.tables import BARS, PANEL, RETURNS, bars, factor_sql, factors, load, query, returns, returns_of

_UNIVERSE = """inst AS (
  SELECT s_suppkey AS instrument_id, DATE '1995-01-01' + CAST(s_suppkey * 9 AS INTEGER) AS list_date, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-01-01' + CAST(s_suppkey AS INTEGER) END AS delist_date,
         CASE WHEN s_nationkey % 4 = 0 THEN 'BSE' ELSE 'MAIN' END AS board, s_suppkey % 13 <> 0 AS metadata_present, s_suppkey * 9 // 30 AS listing_ordinal FROM supplier),
sess AS (SELECT trade_date AS signal_date, row_number() OVER (ORDER BY trade_date) AS session_ordinal FROM (SELECT DISTINCT trade_date FROM bars)),
stat AS (SELECT DISTINCT l_suppkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS signal_date, true AS is_risk_warning, l_suppkey % 2 = 0 AS is_suspended FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R'),
uni AS (
  SELECT d.signal_date, i.instrument_id, list_filter([
    CASE WHEN NOT coalesce(metadata_present, false) THEN 'INSTRUMENT_HISTORY_MISSING' END, CASE WHEN list_date > d.signal_date THEN 'NOT_LISTED_YET' END, CASE WHEN delist_date <= d.signal_date THEN 'DELISTED' END,
    CASE WHEN session_ordinal - listing_ordinal + 1 < 12 THEN 'INSUFFICIENT_LISTING_DAYS' END, CASE WHEN s.is_risk_warning THEN 'RISK_WARNING' END, CASE WHEN s.is_suspended THEN 'SUSPENDED' END,
    CASE WHEN board NOT IN ('MAIN', 'CHINEXT', 'STAR') THEN 'BOARD_NOT_ALLOWED' END], lambda x: x IS NOT NULL) AS reasons
  FROM inst i CROSS JOIN sess d LEFT JOIN stat s ON s.signal_date = d.signal_date AND s.instrument_id = i.instrument_id)"""


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey").cast("int")
    inst = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("instrument_id"), F.date_add(F.lit("1995-01-01").cast("date"), i * 9).alias("list_date"), F.when(i % 5 == 0, F.date_add(F.lit("2000-01-01").cast("date"), i)).alias("delist_date"),
        F.when(F.col("s_nationkey") % 4 == 0, "BSE").otherwise("MAIN").alias("board"), (i % 13 != 0).alias("metadata_present"), F.floor(i * 9 / 30).alias("listing_ordinal"),
    )
    sessions = bars(spark, sf_dir).select(F.col("trade_date").alias("signal_date")).distinct()
    sessions = sessions.withColumn("session_ordinal", F.row_number().over(Window.orderBy("signal_date")))  # a calendar
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    flagged = load(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_returnflag = 'R'").select(month.alias("signal_date"), F.col("l_suppkey").alias("instrument_id")).distinct()
    return dec.batch_universe(inst, sessions, flagged.withColumns({"is_risk_warning": F.lit(True), "is_suspended": F.col("instrument_id") % 2 == 0}), 12)


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {BARS}, {_UNIVERSE} SELECT signal_date, instrument_id, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM uni")
def batch_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_universe(spark, sf_dir))


@query(
    f"""WITH {BARS}, {_UNIVERSE}, liq AS (SELECT instrument_id, trade_date AS signal_date, row_number() OVER o AS n, avg(amount) OVER f AS m FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date), f AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
r AS (SELECT u.signal_date, u.instrument_id, list_concat(u.reasons, list_filter([CASE WHEN coalesce(n, 0) < 6 THEN 'INSUFFICIENT_LIQUIDITY_HISTORY' END, CASE WHEN n IS NULL THEN 'MISSING_LIQUIDITY_OBSERVATIONS' END, CASE WHEN n >= 6 AND m < 150000 THEN 'INSUFFICIENT_AVERAGE_AMOUNT' END], lambda x: x IS NOT NULL)) AS reasons FROM uni u LEFT JOIN liq USING (signal_date, instrument_id))
SELECT signal_date, instrument_id, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM r"""
)
def liquidity_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(dec.liquidity_universe(_universe(spark, sf_dir), bars(spark, sf_dir), 6, 150_000.0))


_THREE = f"WITH {PANEL}{factor_sql(6)}{factor_sql(3, 'factor3')}{factor_sql(12, 'factor12')}, allf AS (SELECT * FROM factor UNION ALL SELECT * FROM factor3 UNION ALL SELECT * FROM factor12)"
_WEIGHTS = {"return_6m": 2.0, "return_3m": -1.0, "return_12m": 1.0}
_CASE = "CASE factor_id WHEN 'return_6m' THEN 2.0 WHEN 'return_3m' THEN -1.0 ELSE 1.0 END"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors(spark, sf_dir, 6, 3, 12)


@query(
    f"""{_THREE}, z AS (SELECT *, CASE WHEN is_valid AND max(value) OVER w > min(value) OVER w THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM allf WINDOW w AS (PARTITION BY signal_date, factor_id))
SELECT signal_date, instrument_id, CASE WHEN count(z) = 3 THEN round(sum(z * {_CASE} / 4.0), 7) END AS score, CASE WHEN count(z) < 3 THEN 'INCOMPLETE_FACTOR_SET' END AS invalid_reason FROM z GROUP BY 1, 2"""
)
def multifactor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dec.multifactor_score(_three(spark, sf_dir), _WEIGHTS), 7)


@query(
    f"""{_THREE}, last AS (SELECT max(signal_date) AS signal_date FROM allf GROUP BY isoyear(signal_date), weekofyear(signal_date)), v AS (SELECT a.* FROM allf a JOIN last USING (signal_date) WHERE is_valid),
m AS (SELECT *, median(value) OVER w AS med, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY signal_date, factor_id)), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY signal_date, factor_id) AS mad FROM m),
x AS (SELECT *, CASE WHEN n >= 3 THEN CASE WHEN mad = 0 THEN value ELSE greatest(least(value, med + 3 * mad), med - 3 * mad) END END AS wv FROM d),
z AS (SELECT *, CASE WHEN max(wv) OVER w > min(wv) OVER w AND wv IS NOT NULL THEN (wv - avg(wv) OVER w) / stddev_pop(wv) OVER w END AS z FROM x WINDOW w AS (PARTITION BY signal_date, factor_id)),
s AS (SELECT signal_date, instrument_id, count(z) AS n_valid, coalesce(sum(z * {_CASE}), 0) AS s FROM z GROUP BY 1, 2)
SELECT c.signal_date, c.instrument_id, coalesce(s.n_valid, 0) AS n_valid, CASE WHEN s.n_valid >= 2 THEN round(s.s, 7) END AS score, CASE WHEN coalesce(s.n_valid, 0) < 2 THEN 'INSUFFICIENT_VALID_FACTORS' END AS invalid_reason
FROM (SELECT DISTINCT signal_date, instrument_id FROM allf JOIN last USING (signal_date)) c LEFT JOIN s USING (signal_date, instrument_id)"""
)
def multifactor_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dec.multifactor_strategy(_three(spark, sf_dir), _WEIGHTS, 2), 7)


@query(
    f"""WITH {BARS}, m AS (SELECT *, CASE WHEN count(*) OVER a = 3 THEN avg(close) OVER a END AS s, CASE WHEN count(*) OVER b = 8 THEN avg(close) OVER b END AS l FROM bars WINDOW a AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 2 PRECEDING), b AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 7 PRECEDING)),
d AS (SELECT *, CASE WHEN s IS NOT NULL AND l IS NOT NULL THEN CASE WHEN s > l THEN 'LONG' ELSE 'FLAT' END END AS direction FROM m)
SELECT instrument_id, trade_date AS signal_date, direction, coalesce(lag(direction) OVER (PARTITION BY instrument_id ORDER BY trade_date) <> direction, false) AS changed, CASE WHEN direction IS NULL THEN 'INSUFFICIENT_MA_WINDOW' END AS invalid_reason FROM d"""
)
def dual_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.dual_ma(bars(spark, sf_dir), 3, 8)


def _rotation_sql(back: int) -> str:
    return f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER o - 1 AS r, close / lag(close, {3 - back}) OVER o - 1 AS r3, close / lag(close, {6 - back}) OVER o - 1 AS r6 FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date)),
s AS (SELECT *, r3 * 0.6 + r6 * 0.4 - CASE WHEN count(r) OVER f = 6 THEN stddev_samp(r) OVER f END * 0.5 AS score, CASE WHEN count(close) OVER f = 6 THEN close / avg(close) OVER f - 1 END AS trend FROM r WINDOW f AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 5 PRECEDING)),
k AS (SELECT *, score IS NOT NULL AND trend IS NOT NULL AND trend > 0 AS in_play FROM s), c AS (SELECT *, in_play AND row_number() OVER (PARTITION BY trade_date ORDER BY in_play DESC, round(score, 9) DESC NULLS LAST, instrument_id) <= 4 AS chosen FROM k)
SELECT trade_date AS signal_date, instrument_id, round(score, 7) AS score, CASE WHEN chosen THEN 1.0::DOUBLE / count(*) FILTER (WHERE chosen) OVER (PARTITION BY trade_date) ELSE 0.0 END AS weight, CASE WHEN score IS NULL OR trend IS NULL THEN 'INSUFFICIENT_ROTATION_WINDOW' END AS invalid_reason FROM c"""


@query(_rotation_sql(0))
def rotation_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.rotation(bars(spark, sf_dir), {3: 0.6, 6: 0.4}, 6, 6, 0.5, 4).withColumn("score", F.round("score", 7))


@query(_rotation_sql(1))
def rotation_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.rotation(bars(spark, sf_dir), {3: 0.6, 6: 0.4}, 6, 6, 0.5, 4, strategy=True).withColumn("score", F.round("score", 7))


_CANDIDATES = f"WITH {RETURNS}, cand AS (SELECT trade_date AS signal_date, instrument_id, log_return AS score, amount AS adv_amount, (instrument_id % 3) / 100.0::DOUBLE AS current_weight, 'n' || CAST(instrument_id % 6 AS VARCHAR) AS industry, close AS price, CAST(volume AS BIGINT) AS quantity FROM ret)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates_of(returns(spark, sf_dir))


def _candidates_of(r: DataFrame) -> DataFrame:
    i = F.col("instrument_id")
    return r.select(F.col("trade_date").alias("signal_date"), "instrument_id", F.col("log_return").alias("score"), F.col("amount").alias("adv_amount"), ((i % 3) / F.lit(100.0)).alias("current_weight"), F.concat(F.lit("n"), (i % 6).cast("string")).alias("industry"), F.col("close").alias("price"), F.col("volume").cast("long").alias("quantity"))


_EQUAL = f"""{_CANDIDATES}, k AS (SELECT *, coalesce(score IS NOT NULL AND adv_amount >= 100000, false) AS fit FROM cand), c AS (SELECT *, fit AND row_number() OVER (PARTITION BY signal_date ORDER BY fit DESC, score DESC NULLS LAST, instrument_id) <= 15 AS chosen FROM k),
target AS (SELECT *, CASE WHEN chosen THEN least(1.0::DOUBLE / count(*) FILTER (WHERE chosen) OVER (PARTITION BY signal_date), 0.08) ELSE 0.0 END AS target_weight FROM c)"""


@query(f"{_EQUAL} SELECT signal_date, instrument_id, current_weight, target_weight FROM target")
def equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.equal_weight(_candidates(spark, sf_dir), 15, 0.08, 100_000.0)


@query(f"{_EQUAL} SELECT signal_date, round(sum(abs(target_weight - current_weight)), 7) AS turnover, round(1 - sum(target_weight), 7) AS cash_weight, sum(current_weight) = 0 AS initial, sum(current_weight) = 0 OR sum(abs(target_weight - current_weight)) <= 1.61 AS within_limit FROM target GROUP BY 1")
def turnover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dec.turnover_check(dec.equal_weight(_candidates(spark, sf_dir), 15, 0.08, 100_000.0), 1.61), 7)


@query(f"{_CANDIDATES}, w AS (SELECT *, adv_amount / 1e7 AS weight FROM cand), i AS (SELECT *, sum(weight) OVER (PARTITION BY signal_date, industry) AS t FROM w) SELECT signal_date, instrument_id, round(weight * least(1.0, 0.05 / t), 10) AS target_weight FROM i")
def industry_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _candidates(spark, sf_dir).withColumn("weight", F.col("adv_amount") / 1e7)
    return dec.industry_cap(w, 0.05).select("signal_date", "instrument_id", F.round("target_weight", 10).alias("target_weight"))


@query(f"{_CANDIDATES}, w AS (SELECT *, adv_amount / 1e7 AS weight FROM cand), s AS (SELECT *, sum(weight) OVER (PARTITION BY signal_date) AS t FROM w), p AS (SELECT signal_date, instrument_id, least(CASE WHEN t > 1 THEN weight / t ELSE weight END, 0.02) AS x FROM s) SELECT signal_date, instrument_id, round(x, 10) AS target_weight, round(1 - sum(x) OVER (PARTITION BY signal_date), 7) AS cash_weight FROM p")
def project_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _candidates(spark, sf_dir).withColumn("weight", F.col("adv_amount") / 1e7)
    return dec.project_allocation(w, 0.02).select("signal_date", "instrument_id", F.round("target_weight", 10).alias("target_weight"), F.round("cash_weight", 7).alias("cash_weight"))


@query(
    f"""{_EQUAL}, p AS (SELECT *, CAST(floor(target_weight * 50000000.0 / price / 100) * 100 AS BIGINT) - quantity AS change FROM target WHERE price > 0)
SELECT signal_date, CAST(row_number() OVER (PARTITION BY signal_date ORDER BY CASE WHEN change < 0 THEN 0 ELSE 1 END, instrument_id) AS INTEGER) AS sequence, instrument_id, CASE WHEN change < 0 THEN 'SELL' ELSE 'BUY' END AS side, abs(change) AS order_quantity FROM p WHERE change <> 0"""
)
def rebalance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(_candidates(spark, sf_dir))


def _plan(c: DataFrame) -> DataFrame:
    t = dec.equal_weight(c, 15, 0.08, 100_000.0).join(c.select("signal_date", "instrument_id", "price", "quantity"), ["signal_date", "instrument_id"])
    return dec.rebalance_plan(t.withColumn("equity", F.lit(5e7)))


@query(f"{_EQUAL} SELECT signal_date, round(max(abs(current_weight - target_weight)), 9) AS largest_gap, max(abs(current_weight - target_weight)) > 0.0601 AS rebalance FROM target GROUP BY 1")
def needs_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dec.needs_rebalance(dec.equal_weight(_candidates(spark, sf_dir), 15, 0.08, 100_000.0), 0.0601), 9)


@query(f"WITH {PANEL}, r AS (SELECT trade_date, instrument_id, coalesce(log_return, 0) AS r FROM panel) SELECT a.instrument_id AS instrument_x, b.instrument_id AS instrument_y, round(covar_samp(a.r, b.r) * CASE WHEN a.instrument_id = b.instrument_id THEN 1.0 ELSE 0.9 END, 8) AS covariance FROM r a JOIN r b USING (trade_date) WHERE a.instrument_id <= b.instrument_id GROUP BY 1, 2, a.instrument_id, b.instrument_id")
def shrunk_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.plans.tables import panel

    rows = panel(spark, sf_dir).withColumnRenamed("log_return", "r")
    return rounded(dec.shrunk_covariance(rows))


@query(
    """SELECT o_orderkey, round(greatest(5.0, o_totalprice / 1e5 * 3) + sqrt(o_totalprice / 1e5) * 2, 8) AS pre_trade, o_totalprice * 0.1::DOUBLE / 1e7 AS capacity,
CAST(round_even(CAST(round(o_totalprice * 100) AS BIGINT) * 2.5 / 10000, 0) AS BIGINT) + CASE WHEN o_orderstatus = 'F' THEN CAST(round_even(CAST(round(o_totalprice * 100) AS BIGINT) * 5.0 / 10000, 0) AS BIGINT) ELSE 0 END AS realized FROM orders"""
)
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    cents = F.round(price * 100).cast("long")
    side = F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(dec.pre_trade_cost(price / 1e5, 5, 3, 2), 8).alias("pre_trade"), dec.capacity_weight(price, 0.1, F.lit(1e7)).alias("capacity"), dec.realized_cost(cents, side, 2.5, 5.0).alias("realized"))


@query(
    f"""{_CANDIDATES}, e AS (SELECT signal_date, instrument_id, adv_amount, CAST((instrument_id % 4) * 1000000 AS BIGINT) AS equity FROM cand), m(model, linear, root) AS (VALUES ('sqrt_impact', 0.00025::DOUBLE, 0.003::DOUBLE), ('linear_impact', 0.00325::DOUBLE, 0.0::DOUBLE), ('fixed_linear', 0.00025::DOUBLE, 0.0::DOUBLE))
SELECT model, signal_date, instrument_id, CASE WHEN equity > 0 THEN round(500.0::DOUBLE / equity, 12) ELSE 0.0::DOUBLE END AS fixed, linear, root AS square_root, CASE WHEN equity > 0 THEN round(greatest(0.0::DOUBLE, adv_amount * 0.1::DOUBLE / (equity / 100)), 9) ELSE 0.0::DOUBLE END AS capacity FROM e, m"""
)
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pre-trade cost models; a quarter of the names belong to a book without equity."""
    rows = _candidates(spark, sf_dir).select("signal_date", "instrument_id", F.col("adv_amount").alias("amount"), (F.col("instrument_id") % 4 * 1000000).alias("equity_cents"))
    out = dec.cost_estimates_by_model(rows, ("sqrt_impact", "linear_impact", "fixed_linear"), 2.5, 500, 30.0)
    return out.select("model", "signal_date", "instrument_id", F.round("fixed", 12).alias("fixed"), F.round("linear", 9).alias("linear"), F.round("square_root", 9).alias("square_root"), F.round("capacity", 9).alias("capacity"))


def strategy_tables(b: DataFrame, nav: DataFrame) -> dict[str, DataFrame]:
    """The tables of strategy runs that are made of bars and of net asset values, of the queries' own steps."""
    daily = perf.daily_returns(nav)
    return {
        "signals": dec.dual_ma(b, 3, 8), "orders": _plan(_candidates_of(returns_of(b))), "performance": rounded(daily, 9), "rolling_performance": _rolling(nav),
        "drawdown_episodes": rounded(perf.drawdown_episodes(daily), 9), "monthly_returns": rounded(perf.period_returns(nav), 9),
    }


# --- performance: portfolios are nations, their equity grows with what their suppliers ship ---

_NAV = """nav AS (
  SELECT n AS portfolio_id, d AS trade_date, 100000000 + CAST(sum(c) OVER (PARTITION BY n ORDER BY d) AS BIGINT) AS equity, 100000000 + CAST(sum(t) OVER (PARTITION BY n ORDER BY d) AS BIGINT) AS benchmark
  FROM (SELECT s_nationkey AS n, CAST(l_shipdate AS DATE) AS d, sum(CAST(l_quantity AS BIGINT) - 25) * 100000 AS c, sum(CAST(l_linenumber AS BIGINT) - 4) * 100000 AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2))"""
_DAILY = f"""WITH {_NAV}, ret_ AS (
  SELECT *, coalesce(equity / nullif(lag(equity) OVER w, 0) - 1, 0) AS daily_return, coalesce(benchmark / nullif(lag(benchmark) OVER w, 0) - 1, 0) AS benchmark_return, max(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS peak, row_number() OVER w AS session FROM nav WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date)),
daily AS (SELECT *, daily_return - benchmark_return AS active_return, equity / nullif(peak, 0) - 1 AS drawdown FROM ret_)"""


def _nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("portfolio_id"))
    rows = load(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("portfolio_id", F.col("l_shipdate").cast("date").alias("trade_date"))
    rows = rows.agg((F.sum(F.col("l_quantity").cast("long") - 25) * 100000).alias("c"), (F.sum(F.col("l_linenumber").cast("long") - 4) * 100000).alias("t"))
    w = Window.partitionBy("portfolio_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("portfolio_id", "trade_date", (F.sum("c").over(w) + 100000000).alias("equity"), (F.sum("t").over(w) + 100000000).alias("benchmark"))


#: All portfolios, one that loses everything, one that begins with nothing, one whose benchmark is worth nothing and one of a single session.
_ODD = f"""WITH {_NAV.replace("nav AS (", "nav0 AS (", 1)}, one AS (SELECT * FROM nav0 WHERE portfolio_id = 3), nav AS (SELECT * FROM nav0 UNION ALL SELECT 400, trade_date, CASE WHEN trade_date < DATE '1996-06-01' THEN equity ELSE 0 END, benchmark FROM one
  UNION ALL SELECT 500, trade_date, CASE WHEN trade_date < DATE '1993-06-01' THEN 0 ELSE equity END, benchmark FROM one UNION ALL SELECT 600, trade_date, equity, 0 FROM one UNION ALL SELECT 700, trade_date, equity, benchmark FROM one WHERE trade_date = (SELECT min(trade_date) FROM one))"""
_ODD_DAILY = _DAILY.replace(f"WITH {_NAV}", _ODD, 1)


def _odd_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = _nav(spark, sf_dir)
    one, day = nav.where("portfolio_id = 3"), lambda d: F.col("trade_date") < F.lit(d).cast("date")
    more = lambda n, e, b: one.select(F.lit(n).alias("portfolio_id"), "trade_date", e.cast("long").alias("equity"), b.cast("long").alias("benchmark"))
    short = more(700, F.col("equity"), F.col("benchmark")).orderBy("trade_date").limit(1)
    lost, late = F.when(day("1996-06-01"), F.col("equity")).otherwise(F.lit(0)), F.when(day("1993-06-01"), F.lit(0)).otherwise(F.col("equity"))
    return nav.union(more(400, lost, F.col("benchmark"))).union(more(500, late, F.col("benchmark"))).union(more(600, F.col("equity"), F.lit(0))).union(short)


@query(f"{_DAILY} SELECT portfolio_id, trade_date, equity, benchmark, round(daily_return, 9) AS daily_return, round(benchmark_return, 9) AS benchmark_return, peak, session, round(active_return, 9) AS active_return, round(drawdown, 9) AS drawdown FROM daily")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.daily_returns(_nav(spark, sf_dir)), 9)


_EXTENDED = _DAILY.replace("ret_ AS (", "more AS (SELECT * FROM nav UNION ALL SELECT portfolio_id + 100, trade_date, 7, 7 FROM nav WHERE portfolio_id = 3 UNION ALL SELECT portfolio_id + 200, trade_date, equity, 9 FROM nav WHERE portfolio_id = 3 UNION ALL SELECT portfolio_id + 300, trade_date, equity, benchmark FROM nav WHERE portfolio_id = 3 AND trade_date = (SELECT min(trade_date) FROM nav WHERE portfolio_id = 3)), ret_ AS (").replace("FROM nav WINDOW w", "FROM more WINDOW w")


@query(
    f"""{_EXTENDED}, s AS (SELECT portfolio_id, count(*) AS n, arg_min(equity, trade_date) AS e0, arg_max(equity, trade_date) AS e1, arg_min(benchmark, trade_date) AS b0, arg_max(benchmark, trade_date) AS b1, min(drawdown) AS max_drawdown FROM daily GROUP BY 1),
m AS (SELECT portfolio_id, avg(daily_return) AS mu, stddev_samp(daily_return) AS sd, sqrt(avg(least(daily_return, 0) ** 2)) AS dd, avg(active_return) AS ma, stddev_samp(active_return) AS sa, covar_samp(daily_return, benchmark_return) AS cv, var_samp(benchmark_return) AS vb, avg(benchmark_return) AS mb, count(*) FILTER (WHERE daily_return > 0) / count(*) AS positive_rate,
  max(daily_return) = min(daily_return) AS flat, max(active_return) = min(active_return) AS flat_a, max(benchmark_return) = min(benchmark_return) AS flat_b FROM daily WHERE session > 1 GROUP BY 1),
j AS (SELECT s.*, mu, sd, dd, ma, sa, mb, positive_rate, CASE WHEN NOT flat_b THEN cv / vb END AS bt, CASE WHEN n - 1 < 2 THEN 'INSUFFICIENT_OBSERVATIONS' END AS few, flat, flat_a, flat_b, CASE WHEN n > 1 THEN (e1 / e0) ** (252.0 / (n - 1)) - 1 END AS ar FROM s LEFT JOIN m USING (portfolio_id)),
k AS (SELECT *, coalesce(few, CASE WHEN flat THEN 'ZERO_VOLATILITY' END) AS r1, coalesce(few, CASE WHEN dd = 0 THEN 'ZERO_DOWNSIDE_DEVIATION' END) AS r2, coalesce(few, CASE WHEN ar IS NULL THEN 'ANNUALIZED_RETURN_NOT_AVAILABLE' WHEN max_drawdown = 0 THEN 'ZERO_MAX_DRAWDOWN' END) AS r3, coalesce(few, CASE WHEN flat_a THEN 'ZERO_ACTIVE_VOLATILITY' END) AS r5, coalesce(few, CASE WHEN flat_b THEN 'ZERO_BENCHMARK_VARIANCE' END) AS r6 FROM j)
SELECT portfolio_id, n - 1 AS n_returns, round(e1 / e0 - 1, 7) AS total_return, round(b1 / b0 - 1, 7) AS benchmark_total_return, round(ar, 7) AS annualized_return, round(sd * sqrt(252), 7) AS volatility, round(max_drawdown, 7) AS max_drawdown, round(positive_rate, 7) AS positive_rate,
CASE WHEN r1 IS NULL THEN round(mu / sd * sqrt(252), 6) END AS sharpe, r1 AS sharpe_reason, CASE WHEN r2 IS NULL THEN round(mu / dd * sqrt(252), 6) END AS sortino, r2 AS sortino_reason, CASE WHEN r3 IS NULL THEN round(ar / -max_drawdown, 6) END AS calmar, r3 AS calmar_reason,
CASE WHEN few IS NULL THEN round(sa * sqrt(252), 6) END AS tracking_error, few AS tracking_error_reason, CASE WHEN r5 IS NULL THEN round(ma / sa * sqrt(252), 6) END AS information_ratio, r5 AS information_ratio_reason, CASE WHEN r6 IS NULL THEN round(bt, 6) END AS beta, r6 AS beta_reason, CASE WHEN r6 IS NULL THEN round((mu - bt * mb) * 252, 6) END AS alpha, r6 AS alpha_reason FROM k"""
)
def performance_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All portfolios, and one that never moves, one with a flat benchmark and one of a single session."""
    nav = _nav(spark, sf_dir)
    one = nav.where("portfolio_id = 3")
    more = lambda n, e, b: one.select((F.col("portfolio_id") + n).alias("portfolio_id"), "trade_date", e.cast("long").alias("equity"), b.cast("long").alias("benchmark"))
    first = Window.partitionBy("portfolio_id").orderBy("trade_date")
    short = more(300, F.col("equity"), F.col("benchmark")).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    nav = nav.union(more(100, F.lit(7), F.lit(7))).union(more(200, F.col("equity"), F.lit(9))).union(short)
    out = perf.headline(perf.daily_returns(nav))
    six = ("sharpe", "sortino", "calmar", "tracking_error", "information_ratio", "beta", "alpha")
    return out.select(*[F.round(c, 6 if c in six else 7).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"{_DAILY}, r AS (SELECT * FROM daily WHERE session > 1), c AS (SELECT portfolio_id, quantile_cont(daily_return, 0.05) AS q FROM r GROUP BY 1) SELECT portfolio_id, round(-q, 8) AS var_95, round(-avg(daily_return), 8) AS es_95 FROM r JOIN c USING (portfolio_id) WHERE daily_return <= q GROUP BY 1, q")
def value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.value_at_risk(perf.daily_returns(_nav(spark, sf_dir))))


@query(
    f"""{_DAILY}, r AS (SELECT portfolio_id, trade_date, session, equity / lag(equity, 252) OVER o AS e, benchmark / lag(benchmark, 252) OVER o AS b, stddev_samp(daily_return) OVER f AS sd, avg(daily_return) OVER f AS mu, stddev_samp(active_return) OVER f AS sa, avg(active_return) OVER f AS ma, covar_samp(daily_return, benchmark_return) OVER f AS cv, var_samp(benchmark_return) OVER f AS vb FROM daily
  WINDOW o AS (PARTITION BY portfolio_id ORDER BY trade_date), f AS (PARTITION BY portfolio_id ORDER BY trade_date ROWS 251 PRECEDING) QUALIFY session > 252),
p AS (SELECT r.portfolio_id, r.trade_date, d.trade_date AS t, d.equity::DOUBLE / max(d.equity) OVER (PARTITION BY r.portfolio_id, r.trade_date ORDER BY d.trade_date) - 1 AS dd FROM r JOIN daily d ON d.portfolio_id = r.portfolio_id AND d.session BETWEEN r.session - 252 AND r.session),
m AS (SELECT portfolio_id, trade_date, min(dd) AS max_drawdown FROM p GROUP BY 1, 2)
SELECT portfolio_id, trade_date, round(e - 1, 7) AS annualized_return, round(b - 1, 7) AS benchmark_annualized_return, round(e / b - 1, 7) AS annualized_excess_return, round(sd * sqrt(252), 7) AS annualized_volatility, round(mu / sd * sqrt(252), 6) AS sharpe_ratio, round(max_drawdown, 7) AS max_drawdown,
round(sa * sqrt(252), 7) AS tracking_error, round(ma / sa * sqrt(252), 6) AS information_ratio, round(cv / vb, 6) AS beta FROM r JOIN m USING (portfolio_id, trade_date)"""
)
def rolling_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(_nav(spark, sf_dir))


def _rolling(nav: DataFrame) -> DataFrame:
    out = perf.rolling_block(perf.daily_returns(nav))
    return out.select(*[F.round(c, 6 if c in ("sharpe_ratio", "information_ratio", "beta") else 7).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    f"""{_ODD_DAILY}, a AS (SELECT *, (equity::DOUBLE / benchmark) / nullif(max(equity::DOUBLE / benchmark) OVER (PARTITION BY portfolio_id ORDER BY trade_date), 0) - 1 AS fall FROM daily),
s AS (SELECT portfolio_id, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS observations, arg_max(equity, trade_date)::DOUBLE / nullif(arg_min(equity, trade_date), 0) AS e, arg_max(benchmark, trade_date)::DOUBLE / nullif(arg_min(benchmark, trade_date), 0) AS b, min(fall) AS fall FROM a GROUP BY 1)
SELECT portfolio_id, start_date, end_date, observations, round(b - 1, 7) AS benchmark_cumulative_return, round(e - b, 7) AS relative_cumulative_return, round(e / nullif(b, 0) - 1, 7) AS geometric_excess_return, round(fall, 7) AS active_max_drawdown, CASE WHEN observations > 1 AND b > 0 THEN round(b ** (252.0 / (observations - 1)) - 1, 7) END AS benchmark_annualized_return,
CASE WHEN observations > 1 AND e / nullif(b, 0) > 0 THEN round((e / b) ** (252.0 / (observations - 1)) - 1, 7) END AS annualized_geometric_excess_return, CASE WHEN observations < 2 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN NOT coalesce(e / nullif(b, 0) > 0 AND b > 0, false) THEN 'ANNUALIZED_RETURN_NOT_AVAILABLE' END AS annualized_reason FROM s"""
)
def relative_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.relative_performance(perf.daily_returns(_odd_nav(spark, sf_dir))), 7)


@query(
    f"""{_DAILY}, t AS (SELECT portfolio_id, min(drawdown) AS max_drawdown, arg_min({{'d': trade_date, 'p': peak}}, {{'x': drawdown, 'd': trade_date}}) AS t, count(*) FILTER (WHERE drawdown < 0) / count(*) AS u FROM daily GROUP BY 1),
r AS (SELECT portfolio_id, max(n) AS n FROM (SELECT portfolio_id, count(*) AS n FROM (SELECT portfolio_id, drawdown, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS g FROM daily) WHERE drawdown < 0 GROUP BY portfolio_id, g) GROUP BY 1),
x AS (SELECT portfolio_id, max_drawdown, t.d AS trough_date, u, (SELECT min(trade_date) FROM daily d WHERE d.portfolio_id = t.portfolio_id AND d.equity = t.t.p AND d.trade_date <= t.t.d) AS peak_date, (SELECT min(trade_date) FROM daily d WHERE d.portfolio_id = t.portfolio_id AND d.equity >= t.t.p AND d.trade_date > t.t.d) AS back FROM t)
SELECT portfolio_id, round(max_drawdown, 7) AS max_drawdown, peak_date, trough_date, CASE WHEN max_drawdown = 0 THEN trough_date ELSE back END AS recovery_date, CASE WHEN max_drawdown < 0 AND back IS NULL THEN 'DRAWDOWN_NOT_RECOVERED' END AS recovery_reason, coalesce(n, 0) AS max_drawdown_duration_sessions, round(u, 7) AS time_under_water_rate FROM x LEFT JOIN r USING (portfolio_id)"""
)
def drawdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.drawdown_summary(perf.daily_returns(_nav(spark, sf_dir))), 7)


_FILLS = """fills AS (SELECT s_nationkey AS portfolio_id, CAST(l_shipdate AS DATE) AS trade_date, CAST(l_quantity AS BIGINT) AS requested_quantity, CASE WHEN l_linenumber > 5 THEN 0 WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) // 2 ELSE CAST(l_quantity AS BIGINT) END AS filled_quantity,
  CASE WHEN l_linenumber <> 7 AND s_nationkey <> 3 THEN (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0::DOUBLE END AS reference_price, CAST(l_quantity AS BIGINT) * 100 AS gross_value, CAST(l_quantity AS BIGINT) AS fees FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 5)"""


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all portfolios but one; another has no prices."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("portfolio_id")).where("portfolio_id <> 5")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    filled = F.when(n > 5, F.lit(0).cast("long")).when(n == 5, F.floor(q / 2)).otherwise(q)
    price = F.when((n != 7) & (F.col("portfolio_id") != 3), F.floor(F.round(F.col("l_extendedprice") * 100).cast("long") / q) / F.lit(100.0))
    return load(spark, sf_dir, "lineitem").join(s, "l_suppkey").select("portfolio_id", F.col("l_shipdate").cast("date").alias("trade_date"), q.alias("requested_quantity"), filled.cast("long").alias("filled_quantity"), price.alias("reference_price"), (q * 100).alias("gross_value"), q.alias("fees"))


@query(
    f"""{_ODD_DAILY}, {_FILLS}, f AS (SELECT portfolio_id, trade_date, sum(gross_value) AS gross, sum(fees) AS fees FROM fills GROUP BY 1, 2),
d AS (SELECT daily.*, coalesce(lag(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date), equity)::DOUBLE AS before, coalesce(gross, 0) AS gross, CASE WHEN session > 1 THEN coalesce(fees, 0) ELSE 0 END AS paid FROM daily LEFT JOIN f USING (portfolio_id, trade_date)),
s AS (SELECT portfolio_id, count(*) - 1 AS n, avg(equity) AS mean_nav, sum(coalesce(gross / nullif(2 * before, 0), 0)) AS turned, CASE WHEN min(abs(1 + daily_return + coalesce(paid / nullif(before, 0), 0))) = 0 THEN 0 ELSE exp(sum(ln(nullif(1 + daily_return + coalesce(paid / nullif(before, 0), 0), 0)))) END AS g, arg_max(equity, trade_date)::DOUBLE / nullif(arg_min(equity, trade_date), 0) AS e FROM d GROUP BY 1),
o AS (SELECT portfolio_id, count(*) AS orders, sum(gross_value) AS traded, sum(fees) AS paid, count(*) FILTER (WHERE filled_quantity = 0 OR filled_quantity < requested_quantity) AS failed, count(reference_price) AS priced, sum(CAST(round(CAST(requested_quantity AS DECIMAL(18,0)) * CAST(reference_price AS DECIMAL(18,6)) * 100, 0) AS BIGINT)) AS asked, sum(CAST(round(CAST(filled_quantity AS DECIMAL(18,0)) * CAST(reference_price AS DECIMAL(18,6)) * 100, 0) AS BIGINT)) AS got FROM fills GROUP BY 1)
SELECT portfolio_id, round(coalesce(traded, 0) / (2 * mean_nav), 9) AS one_way_turnover, CASE WHEN n > 0 THEN round(turned * 252 / n, 9) END AS annualized_turnover, round(coalesce(paid, 0) / mean_nav, 9) AS fee_rate, round(g - 1, 7) AS gross_cumulative_return, CASE WHEN n > 0 AND g > 0 THEN round(g ** (252.0 / n) - 1, 7) END AS gross_annualized_return, round(g - e, 7) AS cumulative_cost_drag, CASE WHEN n > 0 AND g > 0 AND e > 0 THEN round(g ** (252.0 / n) - e ** (252.0 / n), 7) END AS annualized_cost_drag, CASE WHEN n < 1 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN NOT coalesce(g > 0 AND e > 0, false) THEN 'ANNUALIZED_RETURN_NOT_AVAILABLE' END AS annualized_reason,
round(failed / orders, 9) AS failed_fill_rate, CASE WHEN orders IS NULL THEN 'NO_ORDERS' END AS failed_fill_rate_reason, round(got::DOUBLE / asked::DOUBLE, 9) AS notional_fill_rate, CASE WHEN orders IS NULL THEN 'NO_ORDERS' WHEN priced = 0 THEN 'NO_PRICEABLE_ORDERS' END AS notional_fill_rate_reason, round(priced / orders, 9) AS priced_order_coverage_rate FROM s LEFT JOIN o USING (portfolio_id)"""
)
def trading_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perf.trading_metrics(perf.daily_returns(_odd_nav(spark, sf_dir)), _fills(spark, sf_dir))
    seven = ("gross_cumulative_return", "gross_annualized_return", "cumulative_cost_drag", "annualized_cost_drag")
    return out.select(*[F.round(c, 7 if c in seven else 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    f"""WITH {_NAV}, n AS (SELECT *, equity // 4 AS cash, equity // 50 AS dividend_receivable FROM nav), h AS (SELECT portfolio_id, trade_date, i AS security, equity // (10 + i * 3 + portfolio_id) AS market_value FROM n, unnest(range(0, 4)) AS u(i)),
l AS (SELECT portfolio_id, max(market_value::DOUBLE / equity) AS w FROM h JOIN n USING (portfolio_id, trade_date) GROUP BY 1), e AS (SELECT portfolio_id, date_trunc('month', trade_date) AS p, arg_max(equity, trade_date) AS l, arg_min(equity, trade_date) AS f FROM nav GROUP BY 1, 2), g AS (SELECT portfolio_id, l::DOUBLE / coalesce(lag(l) OVER (PARTITION BY portfolio_id ORDER BY p), f) - 1 AS r FROM e), m AS (SELECT portfolio_id, count(*) FILTER (WHERE r > 0) / count(*) AS positive FROM g GROUP BY 1)
SELECT portfolio_id, round(avg(cash::DOUBLE / equity), 9) AS average_cash_weight, round(avg(dividend_receivable::DOUBLE / equity), 9) AS average_receivable_weight, round(any_value(w), 9) AS max_position_weight, round(any_value(positive), 9) AS positive_month_rate FROM n JOIN l USING (portfolio_id) JOIN m USING (portfolio_id) GROUP BY 1"""
)
def holding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda by: F.floor(F.col("equity") / by).cast("long")
    nav = _nav(spark, sf_dir).withColumns({"cash": whole(4), "dividend_receivable": whole(50)})
    held = nav.select("portfolio_id", "trade_date", "equity", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("security")).withColumn("market_value", whole(F.col("security") * 3 + 10 + F.col("portfolio_id")))
    return rounded(perf.holding_metrics(nav, held.drop("equity")), 9)


@query(f"WITH {_NAV} SELECT portfolio_id, trade_date, equity FROM nav WHERE equity % 3 = 1")
def broken_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose parts don't add up to the equity (V10): one cent is put out on some."""
    e, third = F.col("equity"), F.pmod("equity", F.lit(3))
    nav = _nav(spark, sf_dir).withColumns({"cash": F.floor(e / 2).cast("long"), "dividend_receivable": F.lit(700).cast("long"), "short_market_value": F.lit(0).cast("long"), "accrued_fees": F.lit(700).cast("long")})
    nav = nav.withColumn("long_market_value", e - F.col("cash") + F.when(third == 1, 1).otherwise(0))
    return perf.broken_identities(nav).select("portfolio_id", "trade_date", "equity")


@query(
    f"""{_DAILY}, e AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS episode, lag(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS p, lead(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS n FROM daily)
SELECT portfolio_id, CAST(episode AS BIGINT) AS episode, arg_min(p, trade_date) AS peak_date, (list(trade_date ORDER BY drawdown, trade_date))[1] AS trough_date, round(min(drawdown), 9) AS depth, CAST(max({{'d': trade_date, 'n': n}}).n AS DATE) AS recovery_date, count(*) AS n_sessions FROM e WHERE drawdown < 0 GROUP BY 1, 2"""
)
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.drawdown_episodes(perf.daily_returns(_nav(spark, sf_dir))), 9)


@query(f"WITH {_NAV}, e AS (SELECT portfolio_id, CAST(date_trunc('month', trade_date) AS DATE) AS period, arg_max(equity, trade_date) AS l, arg_min(equity, trade_date) AS f FROM nav GROUP BY 1, 2) SELECT portfolio_id, period, round(l / coalesce(lag(l) OVER (PARTITION BY portfolio_id ORDER BY period), f) - 1, 9) AS period_return FROM e")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perf.period_returns(_nav(spark, sf_dir)), 9)


@query(
    """WITH f AS (SELECT *, o_orderkey % 1000 AS q, o_orderkey % 500 AS g, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS p FROM orders)
SELECT o_orderpriority AS portfolio_id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, o_orderstatus AS reason_code, count(*) AS n_orders, CAST(sum(q) AS BIGINT) AS requested, CAST(sum(g) AS BIGINT) AS filled, CAST(sum(q - g) AS BIGINT) AS unfilled,
CAST(coalesce(sum(CAST(round(CAST(q AS DECIMAL(18,0)) * p * 100, 0) AS BIGINT)), 0) AS BIGINT) AS requested_notional, CAST(coalesce(sum(CAST(round(CAST(g AS DECIMAL(18,0)) * p * 100, 0) AS BIGINT)), 0) AS BIGINT) AS filled_notional, count(*) - count(p) AS n_unpriced, round(sum(g) / sum(q), 9) AS fill_rate FROM f GROUP BY 1, 2, 3"""
)
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fills = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("portfolio_id"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("o_orderstatus").alias("reason_code"), (k % 1000).alias("requested_quantity"), (k % 500).alias("filled_quantity"), F.when(k % 9 != 0, F.col("o_totalprice")).alias("reference_price"))
    return rounded(perf.execution_summary(fills), 9)


@query(
    """WITH v AS (SELECT c_nationkey AS portfolio_id, c_custkey AS security, CAST(round(c_acctbal * 100) AS BIGINT) AS x FROM customer), f AS (SELECT c_nationkey AS portfolio_id, o_custkey AS security, sum(CAST(round(o_totalprice) AS BIGINT) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT portfolio_id, security, x + coalesce(y, 0) AS contribution FROM v LEFT JOIN f USING (portfolio_id, security)), r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY abs(contribution) DESC, security) AS n FROM s)
SELECT portfolio_id, CASE WHEN n <= 20 THEN CAST(security AS VARCHAR) ELSE 'OTHER' END AS bucket, CAST(sum(contribution) AS BIGINT) AS contribution, count(*) AS n_names FROM r GROUP BY 1, 2"""
)
def security_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("portfolio_id"), F.col("c_custkey").alias("security"), F.lit(0).alias("begin_value"), F.round(F.col("c_acctbal") * 100).cast("long").alias("end_value"))
    o = load(spark, sf_dir, "orders").join(values.select("portfolio_id", F.col("security").alias("o_custkey")), "o_custkey")
    x, sold = F.round("o_totalprice").cast("long"), F.col("o_orderstatus") == "F"
    flows = o.groupBy("portfolio_id", F.col("o_custkey").alias("security")).agg(F.sum(F.when(sold, x).otherwise(0)).alias("sold"), F.sum(F.when(~sold, x).otherwise(0)).alias("bought"), F.lit(0).alias("dividends"))
    return perf.security_attribution(values, flows)


@query(f"{_ODD_DAILY}, f AS (SELECT s_nationkey AS portfolio_id, CAST(l_shipdate AS DATE) AS trade_date, sum(CAST(l_quantity AS BIGINT)) * 10 AS fees FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), g AS (SELECT d.portfolio_id, d.trade_date, daily_return + coalesce(fees / lag(equity) OVER (PARTITION BY d.portfolio_id ORDER BY d.trade_date), 0) AS gross FROM daily d LEFT JOIN f USING (portfolio_id, trade_date)) SELECT portfolio_id, trade_date, round(gross + 3.1e-13, 12) AS gross_return, CASE WHEN min(abs(1 + gross)) OVER (PARTITION BY portfolio_id ORDER BY trade_date) = 0 THEN 0 ELSE round(exp(sum(ln(nullif(1 + gross, 0))) OVER (PARTITION BY portfolio_id ORDER BY trade_date)), 6) END AS gross_growth FROM g")
def gross_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are moved off the halves before they are rounded, which the two engines round apart."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("portfolio_id"))
    fees = load(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("portfolio_id", F.col("l_shipdate").cast("date").alias("trade_date")).agg((F.sum(F.col("l_quantity").cast("long")) * 10).alias("fees"))
    out = perf.gross_growth(perf.daily_returns(_odd_nav(spark, sf_dir)), fees)
    return out.select("portfolio_id", "trade_date", F.round(F.col("gross_return") + 3.1e-13, 12).alias("gross_return"), F.round("gross_growth", 6).alias("gross_growth"))


# --- data quality -------------------------------------------------------------------


@query(
    f"""WITH {RETURNS}, q AS (SELECT *, close / preclose - 1 + CASE WHEN instrument_id % 9 = 0 THEN 0.01 ELSE 0 END AS pct_change, CASE WHEN instrument_id % 11 = 0 THEN high - 1000 ELSE high END AS h FROM ret)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (open > 0 AND h > 0 AND low > 0 AND close > 0)) AS nonpositive_price, count(*) FILTER (WHERE h < greatest(open, h, low, close) OR low > least(open, h, low, close)) AS price_envelope, count(*) FILTER (WHERE volume < 0 OR amount < 0) AS negative_volume,
count(*) FILTER (WHERE abs(close / preclose - 1 - pct_change) > 0.001) AS pct_change FROM q"""
)
def bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("instrument_id")
    rows = returns(spark, sf_dir).withColumns({"pct_change": F.col("close") / F.col("preclose") - 1 + F.when(i % 9 == 0, 0.01).otherwise(0.0), "high": F.when(i % 11 == 0, F.col("high") - 1000).otherwise(F.col("high"))})
    return quality.counts(rows, quality.bar_violations())


@query(f"WITH {BARS}, c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE l_linenumber = 1) SELECT trade_date FROM c WHERE trade_date <= (SELECT max(trade_date) FROM bars) AND trade_date NOT IN (SELECT trade_date FROM bars)")
def uncovered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_shipdate").cast("date").alias("trade_date")).distinct().withColumn("is_trading_day", F.lit(True))
    return quality.uncovered_days(calendar, bars(spark, sf_dir))


@query("SELECT count(*) AS n_repeated_keys FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_keys(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query(
    """WITH v AS (SELECT 'positive_balance' AS rule, 'SEVERE' AS severity, count(*) FILTER (WHERE c_acctbal < 0) AS n FROM customer)
SELECT 'key_present' AS rule, 'FATAL' AS severity, 0::BIGINT AS n_violations, 'PASS' AS status, false AS blocks UNION ALL SELECT rule, severity, n, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n > 0 FROM v
UNION ALL SELECT 'name_pattern', 'WARNING', (SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')), 'FAIL', false UNION ALL SELECT 'segment_after_balance', 'SEVERE', NULL, 'SKIPPED', false"""
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        quality.Rule("key_present", lambda: quality.required_nulls(["c_custkey"]), "FATAL"),
        quality.Rule("positive_balance", lambda: F.col("c_acctbal") < 0, "SEVERE", ("key_present",)),
        quality.Rule("name_pattern", lambda: quality.bad_identifier("c_name", "^Customer#[0-9]*[02468]$"), "WARNING"),
        quality.Rule("segment_after_balance", lambda: F.col("c_mktsegment").isNull(), "SEVERE", ("positive_balance",)),
    ]
    return quality.run_rules(load(spark, sf_dir, "customer"), rules)


@query(
    """SELECT 'orders' AS dataset, max(CAST(o_orderdate AS DATE)) AS watermark, CASE WHEN max(CAST(o_orderdate AS DATE)) >= DATE '2001-06-30' THEN 'CURRENT' ELSE 'STALE' END AS status FROM orders
UNION ALL SELECT 'lineitem', max(CAST(l_shipdate AS DATE)), CASE WHEN max(CAST(l_shipdate AS DATE)) >= DATE '2001-06-30' THEN 'CURRENT' ELSE 'STALE' END FROM lineitem UNION ALL SELECT 'none', NULL, 'MISSING'"""
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    marks = quality.watermarks([quality.watermark(o, "orders", "d"), quality.watermark(li, "lineitem", "d"), quality.watermark(o.limit(0), "none", "d")])
    return quality.freshness(marks, F.lit("2001-06-30").cast("date"), F.lit(True))
