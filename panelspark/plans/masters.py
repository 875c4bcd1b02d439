"""Queries of masters, the calendar, the industry catalogue, the review of a session, clocks and cleaned strings (S8, M1, §2.13) over the sample tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import clock, text
from panelspark.operators import masters, review
from panelspark.plans.market import _BUCKETS, _PERCENTILES
from panelspark.plans.more import _WARNED, _warned
from panelspark.plans.tables import RETURNS, load, query, returns

_START, _END = date(1996, 1, 1), date(2000, 6, 30)


def _listing(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    first = F.date_add(F.lit(date(1995, 1, 1)), (k * 17 % 1500).cast("int"))
    return F.when(k % 11 != 0, first), F.when(k % 6 == 0, F.date_add(F.lit(date(2000, 1, 1)), (k % 700).cast("int")))


_LISTING = "CASE WHEN s_suppkey % 11 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 17 % 1500 AS INTEGER) END AS list_date, CASE WHEN s_suppkey % 6 = 0 THEN DATE '2000-01-01' + CAST(s_suppkey % 700 AS INTEGER) END AS delist_date"


@query(
    f"""WITH m AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || CASE s_suppkey % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END AS instrument_id, CASE s_suppkey % 3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' ELSE 'BJ' END AS exchange,
CASE WHEN s_suppkey % 3 = 2 THEN 'BSE' WHEN s_suppkey % 5 = 0 THEN 'CHINEXT' WHEN s_suppkey % 5 = 1 THEN 'STAR' ELSE 'MAIN' END AS board, {_LISTING} FROM supplier WHERE s_suppkey % 13 <> 0),
o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '{_START}' AND DATE '{_END}'),
n AS (SELECT instrument_id, count(*) AS sessions FROM m JOIN o ON list_date <= d AND (delist_date IS NULL OR delist_date > d) GROUP BY 1) SELECT m.*, coalesce(sessions, 0) AS sessions FROM m LEFT JOIN n USING (instrument_id)"""
)
def listed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered masters cleaned, with the open days of a range on which each was listed."""
    k = F.col("s_suppkey")
    first, last = _listing("s_suppkey")
    code = F.concat(F.when(k % 13 == 0, "X").otherwise(" "), F.lpad(k.cast("string"), 6, "0"), F.lit("."), F.element_at(F.array(*map(F.lit, ("SH", "SZ", "BJ"))), (k % 3 + 1).cast("int")), F.lit(" "))
    market = F.when(k % 5 == 0, "growth").when(k % 5 == 1, "science").otherwise("other")
    written = F.coalesce(F.when(k % 4 == 0, first.cast("string")).otherwise(F.date_format(first, "yyyyMMdd")), F.lit("None"))
    raw = load(spark, sf_dir, "supplier").select(code.alias("code"), market.alias("market"), written.alias("list_date"), F.coalesce(F.date_format(last, "yyyyMMdd"), F.lit("")).alias("delist_date"))
    ordered = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct()
    span = ordered.agg(F.least(F.min("trade_date"), F.lit(_START)).alias("a"), F.greatest(F.max("trade_date"), F.lit(_END)).alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("trade_date")).join(ordered.withColumn("__o", F.lit(True)), "trade_date", "left")
    days = days.select("trade_date", (F.col("__o").isNotNull() & (F.dayofweek("trade_date") != 1)).alias("is_open"))
    return masters.listed_sessions(masters.instruments(raw), days, _START, _END)


@query(
    """WITH s AS (SELECT c_nationkey AS k, c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1, 2), i AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS code, 'R' || n_regionkey AS up FROM nation WHERE n_nationkey % 7 <> 5)
SELECT 'R' || r_regionkey AS code, 1 AS level, CAST(NULL AS VARCHAR) AS parent_code, 'R' || r_regionkey AS path, true AS is_complete FROM region UNION ALL SELECT code, 2, up, CASE WHEN r_regionkey IS NULL THEN code ELSE up || '/' || code END, r_regionkey IS NOT NULL FROM i LEFT JOIN region ON up = 'R' || r_regionkey
UNION ALL SELECT 'N' || s.k || '-' || g, 3, 'N' || s.k, concat_ws('/', CASE WHEN r_regionkey IS NOT NULL THEN up END, code, 'N' || s.k || '-' || g), r_regionkey IS NOT NULL FROM s LEFT JOIN i USING (k) LEFT JOIN region ON up = 'R' || r_regionkey"""
)
def industry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and segments of customers as a catalogue of three levels, of which some parents are missing."""
    row = lambda code, level, up: (code.alias("code"), F.lit(level).alias("level"), up.alias("parent_code"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = load(spark, sf_dir, "region").select(*row(name("R", "r_regionkey"), 1, F.lit(None).cast("string")))
    nations = load(spark, sf_dir, "nation").where("n_nationkey % 7 <> 5").select(*row(name("N", "n_nationkey"), 2, name("R", "n_regionkey")))
    segments = load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().select(*row(F.concat_ws("-", name("N", "c_nationkey"), "c_mktsegment"), 3, name("N", "c_nationkey")))
    return masters.industry_paths(regions.union(nations).union(segments))


_SUSPENDED = "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS signal_date, l_suppkey AS instrument_id FROM lineitem WHERE l_linenumber = 6"


@query(
    f"""WITH {RETURNS}, {_WARNED}, susp AS ({_SUSPENDED}), mas AS (SELECT s_suppkey AS instrument_id, {_LISTING} FROM supplier), d AS (SELECT DISTINCT trade_date FROM bars),
cell AS (SELECT d.trade_date, m.instrument_id, s.instrument_id IS NOT NULL AS susp, r.amount, (r.close / r.preclose - 1) * 100 AS chg, r.preclose IS NOT NULL AND s.instrument_id IS NULL AS priced FROM d JOIN mas m ON m.list_date <= d.trade_date AND (m.delist_date IS NULL OR m.delist_date > d.trade_date)
  LEFT JOIN warned w ON w.signal_date = d.trade_date AND w.instrument_id = m.instrument_id LEFT JOIN susp s ON s.signal_date = d.trade_date AND s.instrument_id = m.instrument_id LEFT JOIN ret r ON r.trade_date = d.trade_date AND r.instrument_id = m.instrument_id WHERE w.instrument_id IS NULL),
q AS (SELECT d.trade_date, count(c.instrument_id) AS expected_count, count(*) FILTER (WHERE priced) AS priced_count, count(*) FILTER (WHERE susp) AS suspended_count, coalesce(sum(amount), 0) AS amount FROM d LEFT JOIN cell c ON c.trade_date = d.trade_date GROUP BY 1),
ch AS (SELECT trade_date, chg AS change FROM cell WHERE priced), b AS (SELECT trade_date, count(*) FILTER (WHERE change > 0) AS up, count(*) FILTER (WHERE change < 0) AS down, count(*) FILTER (WHERE change = 0) AS flat, {_PERCENTILES}, {_BUCKETS} FROM ch GROUP BY 1),
l AS (SELECT *, list(amount) OVER (ORDER BY trade_date ROWS 19 PRECEDING) AS last, lag(amount) OVER o AS before, avg(amount) OVER (ORDER BY trade_date ROWS 4 PRECEDING) AS a5, avg(amount) OVER (ORDER BY trade_date ROWS 19 PRECEDING) AS a20 FROM q WINDOW o AS (ORDER BY trade_date))
SELECT l.trade_date, expected_count, priced_count, suspended_count, 0::BIGINT AS st_count, greatest(expected_count - suspended_count - priced_count, 0) AS missing_bar_count, CASE WHEN expected_count > suspended_count THEN round(priced_count / (expected_count - suspended_count), 5) END AS coverage_rate,
coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(flat, 0) AS flat, p05, p25, p50, p75, p95, {", ".join(f"coalesce(bucket_{i}, 0) AS bucket_{i}" for i in range(len(review.EDGES) + 1))},
round(amount, 2) AS amount, CASE WHEN before > 0 THEN round(amount / before - 1, 5) END AS change, round(a5, 4) AS average_5, round(a20, 4) AS average_20, round(len(list_filter(last, lambda x: x <= amount)) / len(last), 5) AS percentile_20 FROM l LEFT JOIN b ON b.trade_date = l.trade_date"""
)
def market_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, coverage, breadth and liquidity of every session, without instruments under a warning (M1)."""
    first, last = _listing("s_suppkey")
    master = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id"), first.alias("list_date"), last.alias("delist_date"))
    bars = returns(spark, sf_dir).withColumn("change", (F.col("close") / F.col("preclose") - 1) * 100)
    states = lambda df: df.withColumnRenamed("signal_date", "trade_date")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    suspended = load(spark, sf_dir, "lineitem").where("l_linenumber = 6").select(month.alias("trade_date"), F.col("l_suppkey").alias("instrument_id"))
    out = review.market_review(master, bars.select("trade_date").distinct(), bars, suspended, states(_warned(spark, sf_dir)))
    digits = {"amount": 2, "average_5": 4, "average_20": 4}
    return out.select(*[F.round(c, digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    """WITH l AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS local_ts, timezone('Asia/Shanghai', timezone('UTC', ts)) AS east FROM events),
d AS (SELECT *, CAST(local_ts AS DATE) AS local_day, CAST(east AS DATE) + CASE WHEN CAST(east AS TIME) >= TIME '15:00:00' THEN 1 ELSE 0 END AS session_day FROM l)
SELECT event_id, local_ts, local_day, session_day, timezone('UTC', timezone('America/New_York', CAST(local_day + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND)) AS known_until, CAST(date_diff('day', local_day, session_day) AS INTEGER) AS days_apart, CAST(year(session_day) * 100 + month(session_day) AS INTEGER) AS month FROM d"""
)
def session_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the clocks of one zone, and the session of another that each belongs to (§2.13)."""
    e = load(spark, sf_dir, "events")
    day, session = clock.local_day("ts", "America/New_York"), clock.trading_day("ts", "15:00:00", "Asia/Shanghai")
    rows = e.select("event_id", clock.local_time("ts", "America/New_York").alias("local_ts"), day.alias("local_day"), session.alias("session_day"), clock.day_end(day, "America/New_York").alias("known_until"))
    return rows.withColumns({"days_apart": F.date_diff("session_day", "local_day"), "month": (F.year("session_day") * 100 + F.month("session_day")).cast("int")})


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderkey % 5 IN (0, 2) END AS flag,
CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE round(o_totalprice * 1000, 2) END AS amount, o_orderkey % 4 = 0 AS is_code, CAST(CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE year(o_orderdate) END AS INTEGER) AS year, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS name FROM orders"""
)
def cleaned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered as untidy strings, cleaned (§2.13)."""
    k = F.col("o_orderkey")
    day = F.when(k % 7 == 3, F.element_at(F.array(F.lit("None"), F.lit(" "), F.lit("soon"), F.lit("nan")), (k % 4 + 1).cast("int"))).when(k % 2 == 0, F.date_format("o_orderdate", " yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd\t"))
    flag = F.element_at(F.array(*map(F.lit, ("Y", "", " true ", "N", "0"))), (k % 5 + 1).cast("int"))
    code = F.concat(F.lpad((k % 1_000_000).cast("string"), 6, "0"), F.element_at(F.array(*map(F.lit, (".SZ", ".XX", "SZ", ".SZ.OLD"))), (k % 4 + 1).cast("int")))
    amount = F.when(k % 9 == 4, "NaN").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    raw = load(spark, sf_dir, "orders").select(k.alias("id"), day.alias("day"), flag.alias("flag"), amount.alias("amount"), code.alias("code"), F.when(k % 3 > 0, F.concat(F.lit("\n"), "o_orderpriority", F.lit("  "))).otherwise("  ").alias("name"))
    return raw.select("id", text.to_day("day").alias("day"), text.to_flag("flag").alias("flag"), F.round(text.to_number("amount", 1000), 2).alias("amount"), text.is_code("code").alias("is_code"), text.year_of("day").alias("year"), text.cleaned("name").alias("name"))
