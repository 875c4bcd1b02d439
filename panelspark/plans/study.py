"""Queries of factors, transforms, labels and study statistics (F*, C*) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.numeric import bucket
from panelspark.operators import factors as fx
from panelspark.operators import inference, study, transforms
from panelspark.operators.labels import executable_state, forward_returns
from panelspark.operators.windows import by, rolling_sum
from panelspark.plans.tables import BARS, PANEL, RETURNS, bars, factor, factor_sql, factors, factors_of, kept, labels, labels_of, labels_sql, load, panel, panel_of, query, returns, returns_of


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles to a number of digits, so that engines that add in other orders agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


FLAGSHIP_SQL = f"""WITH {RETURNS}, f AS (
  SELECT instrument_id, trade_date, lead(close) OVER o / close - 1 AS fwd, CASE WHEN count(log_return) OVER w = 20 THEN round(exp(sum(log_return) OVER w) - 1, 9) END AS value
  FROM ret WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date), w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (
  SELECT *, ((row_number() OVER (PARTITION BY trade_date ORDER BY value, instrument_id) - 1) * 5) // count(*) OVER (PARTITION BY trade_date) + 1 AS bucket FROM f WHERE value IS NOT NULL)
SELECT trade_date AS signal_date, CAST(bucket AS INTEGER) AS bucket, count(fwd) AS n_returns, round(avg(fwd), 8) AS mean_return, min(value) AS lower_bound, max(value) AS upper_bound FROM q GROUP BY 1, 2"""


@query(FLAGSHIP_SQL)
def momentum_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, log return, 20-period return, bucket of each session, mean next-period return of each bucket."""
    w = by("instrument_id", "trade_date")
    rows = returns(spark, sf_dir).withColumns({"fwd": F.lead("close").over(w) / F.col("close") - 1, "value": F.round(F.expm1(rolling_sum("log_return", w, 20)), 9)})
    rows = rows.where("value is not null").withColumn("bucket", bucket(5, ["trade_date"], ["value", "instrument_id"]))
    stats = rows.groupBy(F.col("trade_date").alias("signal_date"), "bucket").agg(F.count("fwd").alias("n_returns"), F.round(F.avg("fwd"), 8).alias("mean_return"), F.min("value").alias("lower_bound"), F.max("value").alias("upper_bound"))
    return stats


@query(f"WITH {PANEL} SELECT instrument_id, trade_date, round(log_return, 7) AS log_return FROM panel")
def session_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("instrument_id", "trade_date", F.round("log_return", 7).alias("log_return"))


def _factor_sql(value: str, rows: int, extra: str = "") -> str:
    return f"""WITH {PANEL}{extra}, v AS (
  SELECT trade_date, instrument_id, row_number() OVER o AS n, {value} AS v FROM {'panel' if not extra else 'ext'} WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date))
SELECT trade_date AS signal_date, instrument_id, CASE WHEN n >= {rows} THEN round(v, 8) END AS value, n >= {rows} AND v IS NOT NULL AS is_valid,
       CASE WHEN n < {rows} THEN 'INSUFFICIENT_HISTORY' WHEN v IS NULL THEN 'NONFINITE_VALUE' END AS invalid_reason FROM v"""


def _over(n: int, last: int = 0) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND {'CURRENT ROW' if not last else f'{last} PRECEDING'})"


def _full(n: int, expression: str) -> str:
    return f"CASE WHEN count(log_return) {_over(n)} = {n} THEN {expression} END"


def _market(name: str, value, rows: int, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fx.market_factor(name, value, rows)(panel(spark, sf_dir)).select("signal_date", "instrument_id", "value", "is_valid", "invalid_reason"))

    query(sql, f"factor_{name}")(run)


_WEIGHTS = fx.trend_weights(12)
_TREND = " + ".join(f"{w!r} * lag(log_return, {11 - i}) OVER (PARTITION BY instrument_id ORDER BY trade_date)" for i, w in enumerate(_WEIGHTS, 1))
_PATH = "[list_sum(l[1:j]) for j in range(1, len(l) + 1)]"
_market("return_6m", fx.period_return(6), 7, _factor_sql(_full(6, f"exp(sum(log_return) {_over(6)}) - 1"), 7))
_market("momentum_12_2", fx.skipped_momentum(12, 2), 13, _factor_sql(f"CASE WHEN count(log_return) {_over(12, 2)} = 10 THEN exp(sum(log_return) {_over(12, 2)}) - 1 END", 13))
_market("trend_12m", fx.trend(12), 12, _factor_sql(_full(11, _TREND), 12))
_market("volatility_6m", fx.volatility(6, 12), 7, _factor_sql(_full(6, f"stddev_samp(log_return) {_over(6)} * sqrt(12)"), 7))
_market("downside_volatility_6m", fx.downside_volatility(6, 12), 7, _factor_sql(_full(6, f"sqrt(avg(least(log_return, 0) ** 2) {_over(6)}) * sqrt(12)"), 7))
_market(
    "max_drawdown_12m", fx.drawdown(12), 12,
    _factor_sql("CASE WHEN c = 11 THEN list_max([greatest(0, 1 - exp(p[i] - greatest(0, list_max(p[1:i])))) for i in range(1, 12)]) END", 12,
                f", lists AS (SELECT instrument_id, trade_date, list(log_return) {_over(11)} AS l, count(log_return) {_over(11)} AS c FROM panel), ext AS (SELECT *, {_PATH} AS p FROM lists)"),
)


@query(
    f"""WITH {BARS}, v AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS n, avg(amount) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM bars)
SELECT trade_date AS signal_date, instrument_id, CASE WHEN n >= 5 THEN round(v, 4) END AS value, n >= 5 AS is_valid, CASE WHEN n < 5 THEN 'INSUFFICIENT_HISTORY' END AS invalid_reason FROM v"""
)
def factor_avg_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("available_at", F.col("trade_date").cast("timestamp_ntz"))
    return rounded(fx.observed_mean("avg_amount_5m", "amount", 5)(rows).select("signal_date", "instrument_id", "value", "is_valid", "invalid_reason"), 4)


_BASICS = """basics AS (SELECT c_custkey AS instrument_id, DATE '2000-01-03' AS trade_date, c_acctbal AS x, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2000-01-03 09:00:00' + INTERVAL (CASE WHEN c_custkey % 5 = 0 THEN 24 ELSE 0 END) HOUR END AS available_at FROM customer)"""


def _basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2000-01-03 09:00:00' + CASE WHEN c_custkey % 5 = 0 THEN INTERVAL 24 HOURS ELSE INTERVAL 0 HOURS END")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instrument_id"), F.lit("2000-01-03").cast("date").alias("trade_date"), F.col("c_acctbal").alias("x"), F.when(F.col("c_custkey") % 7 != 0, at).alias("available_at"))


def _fundamental_sql(value: str, valid: str) -> str:
    reason = f"CASE WHEN available_at IS NULL THEN 'AVAILABILITY_UNKNOWN' WHEN available_at >= TIMESTAMP '2000-01-04' THEN 'NOT_KNOWN_ON_DAY' WHEN NOT ({valid}) THEN 'INVALID_DENOMINATOR' END"
    return f"WITH {_BASICS}, r AS (SELECT *, {reason} AS invalid_reason FROM basics) SELECT trade_date AS signal_date, instrument_id, CASE WHEN invalid_reason IS NULL THEN round({value}, 9) END AS value, invalid_reason IS NULL AS is_valid, invalid_reason FROM r"


def _fundamental(name: str, value, valid, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fx.fundamental(name, "x", value, valid)(_basics(spark, sf_dir)).select("signal_date", "instrument_id", "value", "is_valid", "invalid_reason"), 9)

    query(sql, f"factor_{name}")(run)


_fundamental("earnings_yield", fx.inverse, lambda x: x != 0, _fundamental_sql("1 / x", "x <> 0"))
_fundamental("dividend_yield", lambda x: x, lambda x: x >= 0, _fundamental_sql("x", "x >= 0"))
_fundamental("log_market_cap", F.ln, lambda x: x > 0, _fundamental_sql("ln(x)", "x > 0"))

_RECORDS = """records AS (
  SELECT o_custkey % 200 AS instrument_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_period, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 120) DAY AS available_at,
         o_orderkey AS revision, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1e5 - 1 END AS roe FROM orders),
last_revision AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY instrument_id, available_at, report_period ORDER BY revision DESC) = 1),
moved AS (
  SELECT * FROM (SELECT *, max(report_period) OVER (PARTITION BY instrument_id ORDER BY available_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM last_revision)
  WHERE report_period = top QUALIFY row_number() OVER (PARTITION BY instrument_id, available_at ORDER BY report_period DESC) = 1)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(o_orderkey % 120 AS INT))")
    return o.select(
        (F.col("o_custkey") % 200).alias("instrument_id"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("report_period"), at.alias("available_at"),
        F.col("o_orderkey").alias("revision"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1e5 - 1).alias("roe"),
    )


@query(f"WITH {_RECORDS} SELECT instrument_id, available_at, report_period, revision, roe FROM moved")
def financial_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.transitions(_records(spark, sf_dir)).select("instrument_id", "available_at", "report_period", "revision", "roe")


@query(
    f"""WITH {_RECORDS}, asked AS (
  SELECT i.instrument_id, d.trade_date, CAST(d.trade_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS signal_at
  FROM (SELECT DISTINCT instrument_id FROM records) i CROSS JOIN (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date FROM orders) d),
m AS (
  SELECT a.instrument_id, a.trade_date, k.available_at, k.report_period, k.roe, date_diff('day', k.report_period, a.trade_date) AS age
  FROM asked a ASOF LEFT JOIN moved k ON a.instrument_id = k.instrument_id AND a.signal_at >= k.available_at),
r AS (SELECT *, CASE WHEN available_at IS NULL THEN 'NO_RECORD' WHEN roe IS NULL THEN 'MISSING_VALUE' WHEN age < 0 OR age > 190 THEN 'STALE_RECORD' END AS invalid_reason FROM m)
SELECT trade_date AS signal_date, instrument_id, CASE WHEN invalid_reason IS NULL THEN roe END AS value, CASE WHEN invalid_reason IS NULL THEN available_at END AS available_at, invalid_reason IS NULL AS is_valid, invalid_reason FROM r"""
)
def factor_roe(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    dates = load(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("trade_date")).distinct()
    asked = records.select("instrument_id").distinct().crossJoin(F.broadcast(dates))  # months: a few hundred
    return fx.financial("roe", "roe", asked)(records).select("signal_date", "instrument_id", "value", "available_at", "is_valid", "invalid_reason")


_METRICS = {f: i for i, f in enumerate(fx.FINANCIALS)}
_METRIC_SQL = ", ".join(f"CASE WHEN o_orderkey % {7 + i} <> 0 THEN (o_totalprice - {i * 20000}) / 1e5 END AS {fx.FINANCIALS[f]}" for f, i in _METRICS.items())
_WIDE = _RECORDS.replace("CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1e5 - 1 END AS roe", _METRIC_SQL)
_EACH = " UNION ALL ".join(f"SELECT '{f}' AS factor_id, instrument_id, trade_date, available_at, report_period, {c} AS x, age FROM m" for f, c in fx.FINANCIALS.items())


@query(
    f"""WITH {_WIDE}, asked AS (
  SELECT i.instrument_id, d.trade_date, CAST(d.trade_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS signal_at
  FROM (SELECT DISTINCT instrument_id FROM records) i CROSS JOIN (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS trade_date FROM orders) d),
m AS (SELECT a.instrument_id, a.trade_date, k.* EXCLUDE (instrument_id), date_diff('day', k.report_period, a.trade_date) AS age FROM asked a ASOF LEFT JOIN moved k ON a.instrument_id = k.instrument_id AND a.signal_at >= k.available_at),
e AS ({_EACH}), r AS (SELECT *, CASE WHEN available_at IS NULL THEN 'NO_RECORD' WHEN x IS NULL THEN 'MISSING_VALUE' WHEN age < 0 OR age > 190 THEN 'STALE_RECORD' WHEN factor_id = 'leverage' AND x < 0 THEN 'NEGATIVE_VALUE' END AS invalid_reason FROM e)
SELECT factor_id, trade_date AS signal_date, instrument_id, CASE WHEN invalid_reason IS NULL THEN round(x, 9) END AS value, invalid_reason IS NULL AS is_valid, invalid_reason FROM r"""
)
def financial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven financial factors, through the registry."""
    records = _records(spark, sf_dir).drop("roe")
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    wide = o.select(k.alias("revision"), *[F.when(k % (7 + i) != 0, (F.col("o_totalprice") - i * 20000) / 1e5).alias(fx.FINANCIALS[f]) for f, i in _METRICS.items()])
    records = records.join(wide, "revision")
    dates = o.select(F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("trade_date")).distinct()
    asked = records.select("instrument_id").distinct().crossJoin(F.broadcast(dates))  # quarters: a few dozen
    out = fx.compute_factors(fx.Registry().register(*fx.financial_factors(asked)), list(fx.FINANCIALS), {"financials": records})
    return out.select("factor_id", "signal_date", "instrument_id", F.round("value", 9).alias("value"), "is_valid", "invalid_reason")


_fundamental("book_to_price", fx.inverse, lambda x: x != 0, _fundamental_sql("1 / x", "x <> 0"))
_fundamental("sales_yield", fx.inverse, lambda x: x != 0, _fundamental_sql("1 / x", "x <> 0"))


@query(
    f"""WITH {BARS}, t AS (SELECT *, CASE WHEN instrument_id % 9 <> 0 THEN volume / 1e4 END AS rate, row_number() OVER o AS n FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date)),
f AS (SELECT *, avg(rate) OVER w AS v, count(rate) OVER w AS c FROM t WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS 19 PRECEDING)),
r AS (SELECT *, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' WHEN c < 20 THEN 'INVALID_INPUT' END AS invalid_reason FROM f)
SELECT trade_date AS signal_date, instrument_id, CASE WHEN invalid_reason IS NULL THEN round(v, 9) END AS value, invalid_reason IS NULL AS is_valid, invalid_reason FROM r"""
)
def factor_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean turnover of the last twenty observed rows (F8)."""
    rows = bars(spark, sf_dir).withColumns({"available_at": F.col("trade_date").cast("timestamp_ntz"), "turnover_rate_free_float": F.when(F.col("instrument_id") % 9 != 0, F.col("volume") / 1e4)})
    return rounded(fx.observed_mean("turnover_20d", "turnover_rate_free_float", 20)(rows).select("signal_date", "instrument_id", "value", "is_valid", "invalid_reason"), 9)


_STUDY = f"WITH {PANEL}{factor_sql(6)}{labels_sql(1)}"


def _ranked(partition: str) -> str:
    return f"rank() OVER (PARTITION BY {partition} ORDER BY x) + (count(*) OVER (PARTITION BY {partition}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {partition} ORDER BY y) + (count(*) OVER (PARTITION BY {partition}, y) - 1) / 2.0 AS ry"


_IC = f"""{_STUDY}, pairs AS (
  SELECT f.signal_date, f.factor_id, f.value AS x, l.future_return AS y FROM factor f JOIN labels l USING (signal_date, instrument_id) WHERE f.is_valid AND l.future_return IS NOT NULL),
ranked AS (SELECT *, {_ranked('signal_date, factor_id')} FROM pairs),
s AS (SELECT signal_date, factor_id, count(*) AS pair_count, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) END AS ic, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(rx, ry) END AS rank_ic FROM ranked GROUP BY 1, 2),
c AS (SELECT signal_date, factor_id, count(*) FILTER (WHERE is_valid) AS factor_count FROM factor GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(s.pair_count, 0) AS pair_count, s.ic, s.rank_ic, CASE WHEN factor_count < 3 THEN 'INSUFFICIENT_CROSS_SECTION' WHEN coalesce(s.pair_count, 0) < 3 THEN 'INSUFFICIENT_FORWARD_PAIRS' END AS invalid_reason FROM c LEFT JOIN s USING (signal_date, factor_id)),
ic AS (SELECT signal_date, factor_id, factor_count, pair_count, CASE WHEN invalid_reason IS NULL THEN ic END AS ic, CASE WHEN invalid_reason IS NULL THEN rank_ic END AS rank_ic, invalid_reason IS NULL AS is_valid, invalid_reason FROM j)"""


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.daily_ic(factor(spark, sf_dir), labels(spark, sf_dir))


@query(f"{_IC} SELECT signal_date, factor_id, factor_count, pair_count, round(ic, 8) AS ic, round(rank_ic, 8) AS rank_ic, is_valid, invalid_reason FROM ic")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ic(spark, sf_dir))


_BY_NATION = _IC.replace(", pairs AS (", ", by_nation AS (SELECT factor.* REPLACE (factor_id || '/' || s_nationkey AS factor_id) FROM factor JOIN supplier ON s_suppkey = instrument_id), pairs AS (", 1).replace("FROM factor f JOIN labels", "FROM by_nation f JOIN labels").replace("FROM factor GROUP BY", "FROM by_nation GROUP BY").replace("< 3 THEN", "< 2 THEN").replace("AS rank_ic FROM ranked", "AS rank_ic, max(x) = min(x) AS flat_x, max(y) = min(y) AS flat_y FROM ranked").replace("'INSUFFICIENT_FORWARD_PAIRS' END", "'INSUFFICIENT_FORWARD_PAIRS' WHEN s.flat_x THEN 'ZERO_FACTOR_VARIANCE' WHEN s.flat_y THEN 'ZERO_RETURN_VARIANCE' END")


@query(f"{_BY_NATION} SELECT signal_date, factor_id, factor_count, pair_count, round(rank_ic, 6) AS rank_ic, is_valid, invalid_reason FROM ic")
def rank_ic_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank ICs within nations, of cross-sections from two instruments on (C14)."""
    nations = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.col("s_nationkey").cast("string").alias("nation"))
    f = factor(spark, sf_dir).join(nations, "instrument_id").withColumn("factor_id", F.concat_ws("/", "factor_id", "nation"))
    return rounded(study.daily_ic(f, labels(spark, sf_dir), 2).drop("ic"), 6)


@query(
    f"""{_IC} SELECT signal_date, factor_id, round(rank_ic, 8) AS rank_ic,
  round(sum(rank_ic) OVER (PARTITION BY factor_id ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS cumulative_rank_ic,
  CASE WHEN count(rank_ic) OVER w >= 10 THEN round(avg(rank_ic) OVER w, 8) END AS rolling_rank_ic
FROM ic WINDOW w AS (PARTITION BY factor_id ORDER BY signal_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.ic_series(_ic(spark, sf_dir)).select("signal_date", "factor_id", "rank_ic", "cumulative_rank_ic", "rolling_rank_ic"))


_QUANTILES_SUM = ", ".join(f"round(quantile_cont(rank_ic, {p / 100}), 8) AS p{p:02d}" for p in (5, 25, 50, 75, 95))


@query(
    f"""{_IC}, ric AS (SELECT * REPLACE (round(rank_ic, 9) AS rank_ic) FROM ic), runs AS (SELECT *, sum(CASE WHEN rank_ic > 0 THEN 0 ELSE 1 END) OVER o AS u, sum(CASE WHEN rank_ic < 0 THEN 0 ELSE 1 END) OVER o AS d FROM ric WINDOW o AS (PARTITION BY factor_id ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
up AS (SELECT factor_id, max(n) AS n FROM (SELECT factor_id, u, count(*) AS n FROM runs WHERE rank_ic > 0 GROUP BY 1, 2) GROUP BY 1), down AS (SELECT factor_id, max(n) AS n FROM (SELECT factor_id, d, count(*) AS n FROM runs WHERE rank_ic < 0 GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT factor_id, count(*) AS n_dates, count(rank_ic) AS n_valid, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, count(*) FILTER (WHERE rank_ic > 0) / count(rank_ic) AS positive_rate, {_QUANTILES_SUM} FROM ric GROUP BY 1)
SELECT st.factor_id, n_dates, n_valid, round(mean, 8) AS mean, round(std, 8) AS std, round(mean / std, 8) AS icir, round(positive_rate, 8) AS positive_rate, p05, p25, p50, p75, p95, coalesce(up.n, 0) AS longest_positive, coalesce(down.n, 0) AS longest_negative
FROM st LEFT JOIN up USING (factor_id) LEFT JOIN down USING (factor_id)"""
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_ic(spark, sf_dir))


def _summary(ic: DataFrame) -> DataFrame:
    return rounded(study.ic_summary(ic.withColumn("rank_ic", F.round("rank_ic", 9))))


_UNIVERSE = ", universe AS (SELECT signal_date, instrument_id, instrument_id % 4 <> 0 AS eligible FROM factor)"


@query(
    f"""{_STUDY}{_UNIVERSE} SELECT u.signal_date, f.factor_id, count(*) AS eligible_count, count(*) FILTER (WHERE f.is_valid) AS valid_count, round(count(*) FILTER (WHERE f.is_valid) / count(*), 8) AS coverage
FROM universe u JOIN factor f USING (signal_date, instrument_id) WHERE u.eligible GROUP BY 1, 2"""
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(factor(spark, sf_dir))


def _coverage(f: DataFrame) -> DataFrame:
    return rounded(study.coverage(f, f.select("signal_date", "instrument_id", (F.col("instrument_id") % 4 != 0).alias("eligible"))))


_QUANTILES = f"""{_STUDY}, assigned AS (
  SELECT *, CAST(((row_number() OVER (PARTITION BY signal_date ORDER BY value, instrument_id) - 1) * 5) // count(*) OVER (PARTITION BY signal_date) + 1 AS INTEGER) AS quantile FROM factor WHERE is_valid),
qs AS (SELECT a.signal_date, a.factor_id, a.quantile, count(*) AS member_count, count(l.future_return) AS return_count, avg(l.future_return) AS mean_return, min(a.value) AS lower_bound, max(a.value) AS upper_bound FROM assigned a LEFT JOIN labels l USING (signal_date, instrument_id) GROUP BY 1, 2, 3),
quantiles AS (
  SELECT d.signal_date, d.factor_id, d.quantile, coalesce(q.member_count, 0) AS member_count, coalesce(q.return_count, 0) AS return_count, q.mean_return, q.lower_bound, q.upper_bound, q.member_count IS NULL AS is_empty
  FROM (SELECT DISTINCT signal_date, factor_id, unnest([1, 2, 3, 4, 5]) AS quantile FROM factor) d LEFT JOIN qs q USING (signal_date, factor_id, quantile))"""


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.quantile_returns(factor(spark, sf_dir), labels(spark, sf_dir))


@query(f"{_QUANTILES} SELECT signal_date, factor_id, quantile, member_count, return_count, round(mean_return, 8) AS mean_return, lower_bound, upper_bound, is_empty FROM quantiles")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(spark, sf_dir).withColumn("mean_return", F.round("mean_return", 8))


_SPREAD = f"""{_QUANTILES}, spreads AS (
  SELECT signal_date, factor_id, CASE WHEN max(return_count) FILTER (WHERE quantile = 5) > 0 AND max(return_count) FILTER (WHERE quantile = 1) > 0 THEN max(mean_return) FILTER (WHERE quantile = 5) - max(mean_return) FILTER (WHERE quantile = 1) END AS spread,
         CASE WHEN NOT (max(return_count) FILTER (WHERE quantile = 5) > 0 AND max(return_count) FILTER (WHERE quantile = 1) > 0) THEN 'MISSING_TERMINAL_QUANTILE_OBSERVATIONS' END AS invalid_reason FROM quantiles GROUP BY 1, 2)"""


@query(f"{_SPREAD} SELECT signal_date, factor_id, round(spread, 8) AS spread, invalid_reason FROM spreads")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.long_short(_quantiles(spark, sf_dir)))


@query(
    f"""{_QUANTILES}, rq AS (SELECT * REPLACE (round(mean_return, 9) AS mean_return) FROM quantiles), v AS (SELECT *, rank() OVER (PARTITION BY signal_date ORDER BY mean_return) + (count(*) OVER (PARTITION BY signal_date, mean_return) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY signal_date ORDER BY quantile) AS qr, lag(mean_return) OVER (PARTITION BY signal_date ORDER BY quantile) AS before FROM rq WHERE mean_return IS NOT NULL)
SELECT signal_date, factor_id, count(*) AS n_buckets, round(CASE WHEN max(r) > min(r) THEN corr(qr, r) END, 8) AS rank_correlation, round(regr_slope(mean_return, quantile), 8) AS slope,
       CAST(count(*) FILTER (WHERE mean_return < before) AS BIGINT) AS inversions, round(arg_max(mean_return, quantile) - arg_min(mean_return, quantile), 8) AS terminal_spread, NULL::VARCHAR AS invalid_reason FROM v GROUP BY 1, 2 HAVING count(*) >= 3
UNION ALL SELECT signal_date, factor_id, count(*), NULL, NULL, NULL, NULL, 'INSUFFICIENT_VALID_QUANTILES' FROM v GROUP BY 1, 2 HAVING count(*) < 3"""
)
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monotonicity(_quantiles(spark, sf_dir))


def _monotonicity(quantiles: DataFrame) -> DataFrame:
    return rounded(study.monotonicity(quantiles.withColumn("mean_return", F.round("mean_return", 9))))


_TURNOVER = f"""{_SPREAD}, dates AS (SELECT signal_date, factor_id, lag(signal_date) OVER (PARTITION BY factor_id ORDER BY signal_date) AS previous_date FROM (SELECT DISTINCT signal_date, factor_id FROM factor)),
legs AS (SELECT signal_date, instrument_id, quantile, value, 1.0 / count(*) OVER (PARTITION BY signal_date, quantile) AS w FROM assigned),
moves AS (
  SELECT d.signal_date, k.q AS q, 0.5 * (SELECT sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) FROM (SELECT * FROM legs WHERE legs.signal_date = d.signal_date AND legs.quantile = k.q) a FULL JOIN (SELECT * FROM legs WHERE legs.signal_date = d.previous_date AND legs.quantile = k.q) b USING (instrument_id)) AS t,
         (SELECT count(*) FROM legs WHERE legs.signal_date = d.signal_date AND legs.quantile = k.q) AS n, (SELECT count(*) FROM legs WHERE legs.signal_date = d.previous_date AND legs.quantile = k.q) AS m
  FROM dates d, (VALUES (1), (5)) k(q)),
both_ AS (SELECT a.signal_date, a.value AS x, b.value AS y FROM assigned a JOIN dates d USING (signal_date) JOIN assigned b ON b.signal_date = d.previous_date AND b.instrument_id = a.instrument_id),
ac AS (SELECT signal_date, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(rx, ry) END AS rank_autocorrelation FROM (SELECT *, {_ranked('signal_date')} FROM both_) GROUP BY 1),
turnover AS (
  SELECT d.signal_date, d.factor_id, d.previous_date, max(CASE WHEN m.q = 5 AND m.n > 0 AND m.m > 0 THEN m.t END) AS top_turnover, max(CASE WHEN m.q = 1 AND m.n > 0 AND m.m > 0 THEN m.t END) AS bottom_turnover, max(ac.rank_autocorrelation) AS rank_autocorrelation
  FROM dates d JOIN moves m USING (signal_date) LEFT JOIN ac USING (signal_date) GROUP BY 1, 2, 3)"""


@query(f"{_TURNOVER} SELECT signal_date, factor_id, previous_date, round(top_turnover, 8) AS top_turnover, round(bottom_turnover, 8) AS bottom_turnover, round(top_turnover + bottom_turnover, 8) AS turnover, round(rank_autocorrelation, 8) AS rank_autocorrelation, CASE WHEN previous_date IS NULL THEN 'NO_PREVIOUS_SIGNAL_DATE' WHEN top_turnover + bottom_turnover IS NULL THEN 'MISSING_TERMINAL_QUANTILE' END AS invalid_reason FROM turnover")
def quantile_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.quantile_turnover(factor(spark, sf_dir)))


@query(
    f"""{_TURNOVER}, cs AS (SELECT s.factor_id, count(*) AS n_dates, avg(spread) AS gross, avg(top_turnover + bottom_turnover) AS mean_turnover, sum(spread) AS a, sum(top_turnover + bottom_turnover) AS b FROM spreads s JOIN turnover t USING (signal_date, factor_id) WHERE spread IS NOT NULL AND top_turnover + bottom_turnover IS NOT NULL GROUP BY 1)
SELECT factor_id, n_dates, cost_bps, round(gross, 8) AS gross, round(mean_turnover, 8) AS mean_turnover, round(gross - mean_turnover * cost_bps / 10000, 8) AS net, CASE WHEN a > 0 AND b > 0 THEN round(10000 * a / b, 6) END AS break_even_bps, CASE WHEN a <= 0 THEN 'NONPOSITIVE_GROSS_SPREAD' WHEN b <= 0 THEN 'ZERO_TOTAL_TURNOVER' END AS break_even_invalid_reason
FROM cs, (SELECT unnest([0.0, 5.0, 10.0, 20.0, 50.0])::DOUBLE AS cost_bps)"""
)
def cost_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(_quantiles(spark, sf_dir), study.quantile_turnover(factor(spark, sf_dir)))


def _costs(quantiles: DataFrame, turnover: DataFrame) -> DataFrame:
    out = study.cost_scenarios(study.long_short(quantiles), turnover)
    return out.select("factor_id", "n_dates", "cost_bps", *[F.round(c, 8).alias(c) for c in ("gross", "mean_turnover", "net")], F.round("break_even_bps", 6).alias("break_even_bps"), "break_even_invalid_reason")


@query(
    f"""WITH {PANEL}{factor_sql(6)}{factor_sql(3, "factor3")}{factor_sql(12, "factor12")}, allf AS (SELECT * FROM factor WHERE is_valid UNION ALL SELECT * FROM factor3 WHERE is_valid UNION ALL SELECT * FROM factor12 WHERE is_valid),
pairs AS (SELECT a.signal_date, a.factor_id AS factor_x, b.factor_id AS factor_y, a.value AS x, b.value AS y FROM allf a JOIN allf b USING (signal_date, instrument_id)),
daily AS (SELECT signal_date, factor_x, factor_y, count(*) AS n, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) END AS p, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(rx, ry) END AS r FROM (SELECT *, {_ranked('signal_date, factor_x, factor_y')} FROM pairs) GROUP BY 1, 2, 3)
SELECT factor_x, factor_y, count(*) AS n_dates, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(p), 8) AS pearson, round(avg(r), 8) AS rank FROM daily WHERE n >= 3 AND p IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2"""
)
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.factor_correlations(factors(spark, sf_dir, 6, 3, 12)))


@query(
    f"""WITH {PANEL}{labels_sql(1)}{labels_sql(3, "labels3")}, l AS (SELECT * FROM labels UNION ALL SELECT * FROM labels3)
SELECT horizon, label_kind, coalesce(invalid_reason, 'VALID') AS reason, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (PARTITION BY horizon), 8) AS share FROM l GROUP BY 1, 2, 3"""
)
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.label_quality(labels(spark, sf_dir, (1, 3))))


def study_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a study by name, of the queries' own steps. What several are made of is worked out once and kept: bars, panel, factors, labels, and the statistics by date."""
    from panelspark.plans import more

    b = kept(bars(spark, sf_dir).select("instrument_id", "trade_date", "open", "close"), "bars")
    cells = kept(panel_of(returns_of(b)), "panel")
    all_factors = kept(factors_of(cells, 6, 3, 12), "factors")
    all_labels = kept(labels_of(cells, b, (1, 3)), "labels")
    f, l = all_factors.where("factor_id = 'return_6m'"), all_labels.where("horizon = 1")
    ic, quantiles, turnover = kept(study.daily_ic(f, l), "ic"), kept(study.quantile_returns(f, l), "quantiles"), kept(study.quantile_turnover(f), "turnover")
    return {
        "summary": _summary(ic), "coverage": _coverage(f), "label_quality": rounded(study.label_quality(all_labels)), "industry_coverage": more.industry_rows(f), "ic": rounded(ic),
        "quantile_returns": quantiles.withColumn("mean_return", F.round("mean_return", 8)), "long_short_returns": rounded(study.long_short(quantiles)), "monotonicity": _monotonicity(quantiles), "turnover": rounded(turnover),
        "cost_scenarios": _costs(quantiles, turnover), "correlations": rounded(study.factor_correlations(all_factors)),
    }


@query(f"WITH {PANEL}{labels_sql(3)} SELECT signal_date, instrument_id, horizon, label_kind, return_start, return_end, future_return, is_valid, invalid_reason FROM labels")
def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir, (3,))


_CROSS = "cross_ AS (SELECT l_suppkey * 1000 + month(l_shipdate) AS instrument_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS signal_date, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100.0::DOUBLE AS value, max(l_extendedprice) AS cap, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'n' || CAST(l_suppkey % 30 AS VARCHAR) END AS industry FROM lineitem GROUP BY l_suppkey, month(l_shipdate), CAST(date_trunc('year', l_shipdate) AS DATE))"


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month(F.col("l_shipdate").cast("date"))
    year = F.trunc(F.col("l_shipdate").cast("date"), "year")
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", month.alias("m"), year.alias("signal_date")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)).alias("value"), F.max("l_extendedprice").alias("cap"))
    industry = F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("l_suppkey") % 30).cast("string")))
    return rows.select((F.col("l_suppkey") * 1000 + F.col("m")).alias("instrument_id"), "signal_date", "value", "cap", industry.alias("industry"))


def _transform(name: str, run, sql: str) -> None:
    query(sql, name)(lambda spark, sf_dir: rounded(run(_cross(spark, sf_dir)), 6))


_transform(
    "winsorize_mad", lambda d: transforms.winsorize_mad(d, "value", ["signal_date"]),
    f"""WITH {_CROSS}, m AS (SELECT *, median(value) OVER (PARTITION BY signal_date) AS med, count(*) OVER (PARTITION BY signal_date) AS n FROM cross_), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY signal_date) AS mad FROM m)
SELECT instrument_id, signal_date, value, cap, industry, CASE WHEN n >= 3 THEN round(CASE WHEN mad = 0 THEN value ELSE greatest(least(value, med + 3 * mad), med - 3 * mad) END, 6) END AS winsorized, n >= 3 AS is_valid, CASE WHEN n < 3 THEN 'INSUFFICIENT_CROSS_SECTION' END AS invalid_reason FROM d""",
)
_transform(
    "zscore", lambda d: transforms.zscore(d, "value", ["signal_date"]),
    f"""WITH {_CROSS}, s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, max(value) OVER w = min(value) OVER w AS flat FROM cross_ WINDOW w AS (PARTITION BY signal_date))
SELECT instrument_id, signal_date, value, cap, industry, CASE WHEN NOT flat THEN round((value - m) / sd, 6) END AS zscore, NOT flat AS is_valid, CASE WHEN flat THEN 'ZERO_VARIANCE' END AS invalid_reason FROM s""",
)
_transform(
    "neutralize_industry", lambda d: transforms.neutralize_industry(d, "value", ["signal_date"], "industry"),
    f"""WITH {_CROSS}, s AS (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM cross_ WINDOW w AS (PARTITION BY signal_date, industry)), r AS (SELECT *, CASE WHEN industry = '' THEN 'MISSING_INDUSTRY' WHEN n < 2 THEN 'SINGLE_MEMBER_INDUSTRY' END AS invalid_reason FROM s)
SELECT instrument_id, signal_date, value, cap, industry, CASE WHEN invalid_reason IS NULL THEN round(value - m, 6) END AS neutralized, invalid_reason IS NULL AS is_valid, invalid_reason FROM r""",
)
_transform(
    "neutralize_market_cap", lambda d: transforms.neutralize_market_cap(d, "value", ["signal_date"], "cap").withColumn("neutralized", F.round("neutralized", 3)),
    f"""WITH {_CROSS}, s AS (SELECT *, value - avg(value) OVER w AS dv, ln(cap) - avg(ln(cap)) OVER w AS dx, count(*) OVER w AS n FROM cross_ WINDOW w AS (PARTITION BY signal_date)), r AS (SELECT *, sum(dv * dx) OVER w AS sxy, sum(dx * dx) OVER w AS sxx FROM s WINDOW w AS (PARTITION BY signal_date)), e AS (SELECT *, CASE WHEN n < 3 THEN 'INSUFFICIENT_CROSS_SECTION' WHEN sxx = 0 THEN 'ZERO_MARKET_CAP_VARIANCE' END AS invalid_reason FROM r)
SELECT instrument_id, signal_date, value, cap, industry, CASE WHEN invalid_reason IS NULL THEN round(dv - sxy / sxx * dx, 3) END AS neutralized, invalid_reason IS NULL AS is_valid, invalid_reason FROM e""",
)
_transform(
    "neutralize_industry_market_cap", lambda d: transforms.neutralize_industry_market_cap(d, "value", ["signal_date"], "industry", "cap").withColumn("neutralized", F.round("neutralized", 3)),
    f"""WITH {_CROSS}, i AS (SELECT *, CASE WHEN industry = '' THEN 'MISSING_INDUSTRY' WHEN count(*) OVER w < 2 THEN 'SINGLE_MEMBER_INDUSTRY' END AS reason, value - avg(value) OVER w AS v1, ln(cap) - avg(ln(cap)) OVER w AS x1 FROM cross_ WINDOW w AS (PARTITION BY signal_date, industry)),
s AS (SELECT *, v1 - avg(v1) FILTER (WHERE reason IS NULL) OVER w AS dv, x1 - avg(x1) FILTER (WHERE reason IS NULL) OVER w AS dx, count(*) FILTER (WHERE reason IS NULL) OVER w AS n FROM i WINDOW w AS (PARTITION BY signal_date)), r AS (SELECT *, sum(dv * dx) FILTER (WHERE reason IS NULL) OVER w AS sxy, sum(dx * dx) FILTER (WHERE reason IS NULL) OVER w AS sxx FROM s WINDOW w AS (PARTITION BY signal_date)),
e AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN n < 3 THEN 'INSUFFICIENT_CROSS_SECTION' WHEN sxx = 0 THEN 'ZERO_MARKET_CAP_VARIANCE' END AS invalid_reason FROM r)
SELECT instrument_id, signal_date, value, cap, industry, CASE WHEN invalid_reason IS NULL THEN round(dv - sxy / sxx * dx, 3) END AS neutralized, invalid_reason IS NULL AS is_valid, invalid_reason FROM e""",
)


def _hac_sql(horizon: int) -> str:
    lags = ", ".join(f"coalesce(sum(e * e{k}), 0) AS g{k}" for k in range(horizon))
    cols = ", ".join(f"lag(e, {k}) OVER (PARTITION BY factor_id ORDER BY signal_date) AS e{k}" for k in range(horizon))
    terms = " + ".join(["g0", *(f"CASE WHEN {k} <= lag THEN 2 * (1 - {k} / (lag + 1.0)) * g{k} ELSE 0 END" for k in range(1, horizon))])
    return f"""{_IC}, dev AS (SELECT *, rank_ic - avg(rank_ic) OVER (PARTITION BY factor_id) AS e FROM ic), lagged AS (SELECT *, {cols} FROM dev),
g AS (SELECT factor_id, count(*) AS sessions, count(rank_ic) AS n_valid, avg(rank_ic) AS mean, {lags} FROM lagged GROUP BY 1), h AS (SELECT *, greatest(least({horizon - 1}, sessions - 1), 0) AS lag FROM g), v AS (SELECT *, ({terms}) / n_valid AS lrv FROM h), r AS (SELECT *, sqrt(lrv / n_valid) AS se FROM v)
SELECT factor_id, n_valid, CAST(lag AS INTEGER) AS lag, round(mean, 8) AS mean, round(se, 8) AS se, round(mean / se, 6) AS t, round(mean - 1.959963984540054 * se, 8) AS ci_low, round(mean + 1.959963984540054 * se, 8) AS ci_high FROM r"""


@query(_hac_sql(4))
def hac_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.hac_mean(_ic(spark, sf_dir), "rank_ic", ["factor_id"], "signal_date", 4, p_values=False)
    return out.select("factor_id", "n_valid", "lag", *[F.round(c, 8).alias(c) for c in ("mean", "se", "ci_low", "ci_high")], F.round("t", 6).alias("t"))


@query(
    """WITH t AS (SELECT p_partkey AS test_id, p_size % 3 AS family, CASE WHEN p_partkey % 17 <> 0 THEN round(p_retailprice / 100000, 6) END AS p FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family ORDER BY p, test_id) AS r FROM t WHERE p IS NOT NULL)
SELECT test_id, family, p, round(least(1.0, p * n), 9) AS bonferroni, round(least(1.0, min(p * n / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS bh_fdr FROM k UNION ALL SELECT test_id, family, p, NULL, NULL FROM t WHERE p IS NULL"""
)
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), (F.col("p_size") % 3).alias("family"), F.when(F.col("p_partkey") % 17 != 0, F.round(F.col("p_retailprice") / 100000, 6)).alias("p"))
    return rounded(inference.adjusted_p_values(rows, "family", "p", "test_id"), 9)


@query()
def hac_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAC mean of the rank IC with its p-value (erfc has no SQL form)."""
    return inference.hac_mean(_ic(spark, sf_dir), "rank_ic", ["factor_id"], "signal_date", 4)


_STATE = """inst AS (SELECT s_suppkey AS instrument_id, DATE '1995-01-01' + CAST(s_suppkey * 9 AS INTEGER) AS list_date, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-01-01' + CAST(s_suppkey AS INTEGER) END AS delist_date FROM supplier),
susp AS (SELECT DISTINCT l_suppkey AS instrument_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R'),
tick AS (SELECT instrument_id, trade_date, CAST(floor(open) AS BIGINT) AS open_ticks, CAST(floor(preclose) AS BIGINT) AS preclose_ticks FROM ret),
cells AS (SELECT i.*, d.trade_date, i.list_date <= d.trade_date AND (i.delist_date IS NULL OR i.delist_date > d.trade_date) AS is_listed FROM inst i CROSS JOIN (SELECT DISTINCT trade_date FROM bars) d),
aged AS (SELECT *, sum(CASE WHEN is_listed THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age FROM cells),
state AS (SELECT a.instrument_id, a.trade_date, a.is_listed, s.instrument_id IS NOT NULL AS is_suspended, coalesce(a.age > 5 AND t.open_ticks >= (2 * t.preclose_ticks * 110 + 100) // 200, false) AS entry_limit_up
  FROM aged a LEFT JOIN susp s USING (instrument_id, trade_date) LEFT JOIN tick t USING (instrument_id, trade_date))"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey").cast("int")
    inst = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.date_add(F.lit("1995-01-01").cast("date"), i * 9).alias("list_date"), F.when(i % 5 == 0, F.date_add(F.lit("2000-01-01").cast("date"), i)).alias("delist_date"))
    r = returns(spark, sf_dir)
    susp = load(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("instrument_id"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trade_date"))
    ticks = r.select("instrument_id", "trade_date", F.floor("open").cast("long").alias("open_ticks"), F.floor("preclose").cast("long").alias("preclose_ticks"))
    return executable_state(inst, r.select("trade_date"), ticks, susp)


@query(f"WITH {RETURNS}, {_STATE} SELECT * FROM state")
def executable_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


@query(
    f"""WITH {PANEL}, {_STATE}{labels_sql(2)}, r AS (
  SELECT l.signal_date, l.instrument_id, l.future_return, l.invalid_reason AS price_reason, l.return_end,
         CASE WHEN l.return_end IS NULL THEN 'INCOMPLETE_FORWARD_WINDOW' WHEN NOT coalesce(a.is_listed, false) THEN 'NOT_LISTED_AT_ENTRY' WHEN coalesce(a.is_suspended, true) THEN 'ENTRY_SUSPENDED'
              WHEN coalesce(a.entry_limit_up, false) THEN 'ENTRY_LIMIT_UP' WHEN l.invalid_reason = 'MISSING_EXIT_PRICE' AND NOT coalesce(b.is_listed, true) THEN 'DELISTED_WITHOUT_EXIT_PRICE' ELSE l.invalid_reason END AS invalid_reason
  FROM labels l LEFT JOIN state a ON a.instrument_id = l.instrument_id AND a.trade_date = l.return_start LEFT JOIN state b ON b.instrument_id = l.instrument_id AND b.trade_date = l.return_end)
SELECT signal_date, instrument_id, CASE WHEN invalid_reason IS NULL THEN future_return END AS future_return, invalid_reason IS NULL AS is_valid, invalid_reason FROM r"""
)
def executable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    cells = panel(spark, sf_dir).select(F.col("trade_date").alias("signal_date"), "instrument_id")
    out = forward_returns(cells, b.select("trade_date"), b, (2,), _state(spark, sf_dir))
    return out.select("signal_date", "instrument_id", "future_return", "is_valid", "invalid_reason")


@query(
    f"""{_STUDY}, n AS (SELECT *, count(*) FILTER (WHERE is_valid) OVER (PARTITION BY signal_date) < 90 AS few FROM factor)
SELECT signal_date, instrument_id, CASE WHEN NOT (few AND is_valid) THEN value END AS value, is_valid AND NOT few AS is_valid, CASE WHEN few AND is_valid THEN 'INSUFFICIENT_CROSS_SECTION' ELSE invalid_reason END AS invalid_reason FROM n"""
)
def minimum_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.minimum_mask(factor(spark, sf_dir), ["signal_date"], 90).select("signal_date", "instrument_id", "value", "is_valid", "invalid_reason")


@query(
    f"""{_STUDY}, dates_ AS (SELECT signal_date, lag(signal_date) OVER (ORDER BY signal_date) AS before FROM (SELECT DISTINCT signal_date FROM factor))
SELECT f.signal_date, f.instrument_id, f.value, p.value AS previous_value FROM factor f JOIN dates_ d USING (signal_date) LEFT JOIN factor p ON p.signal_date = d.before AND p.instrument_id = f.instrument_id"""
)
def previous_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.previous_values(factor(spark, sf_dir)).select("signal_date", "instrument_id", "value", "previous_value")
