"""Queries of market rules, backtests and the market review (R*, X*, L*, M*) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import backtest, review, rules
from panelspark.plans.study import rounded
from panelspark.plans.tables import BARS, RETURNS, bars, load, query, returns


def _values(rows: list[tuple], columns: str) -> str:
    cells = lambda r: ", ".join("NULL" if x is None else f"'{x}'" for x in r)
    return f"(VALUES {', '.join(f'({cells(r)})' for r in rows)}) t({columns})"


_MARKET = """market AS (
  SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) + 4000 AS trade_date, ['MAIN', 'CHINEXT', 'STAR', 'BSE'][1 + l_suppkey % 4] AS limit_group, CASE WHEN l_suppkey % 7 = 0 THEN 'ST' ELSE 'NORMAL' END AS status,
         1000 + l_suppkey * 7 AS preclose_ticks, 1000 + l_suppkey * 7 + CAST(sum(l_linenumber) - 4 AS BIGINT) * 37 AS open_ticks, CAST(sum(l_quantity) AS BIGINT) * 40 AS volume, max(l_returnflag) = 'R' AND l_suppkey % 5 = 0 AS is_suspended
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""
_LIMITS = f"""lim AS (SELECT limit_group, status, CAST(a AS DATE) AS a, coalesce(CAST(z AS DATE), DATE '9999-12-31') AS z, CAST(rate AS DECIMAL(12, 8)) AS rate FROM {_values(rules.PRICE_LIMITS, "limit_group, status, a, z, rate")}),
limited AS (SELECT m.*, CAST(round(CAST(preclose_ticks AS DECIMAL(18, 0)) * (1 + rate), 0) AS BIGINT) AS upper_ticks, CAST(round(CAST(preclose_ticks AS DECIMAL(18, 0)) * (1 - rate), 0) AS BIGINT) AS lower_ticks
  FROM market m LEFT JOIN lim ON lim.limit_group = m.limit_group AND lim.status = m.status AND m.trade_date BETWEEN a AND z)"""


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_suppkey")
    rows = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.date_add(F.col("l_shipdate").cast("date"), 4000).alias("trade_date")).agg(F.sum("l_linenumber").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"))
    group = F.element_at(F.array(*[F.lit(x) for x in ("MAIN", "CHINEXT", "STAR", "BSE")]), (i % 4 + 1).cast("int"))
    return rows.select(
        i.alias("instrument_id"), "trade_date", group.alias("limit_group"), F.when(i % 7 == 0, "ST").otherwise("NORMAL").alias("status"), (i * 7 + 1000).alias("preclose_ticks"),
        (i * 7 + 1000 + (F.col("n") - 4) * 37).alias("open_ticks"), (F.col("q") * 40).alias("volume"), ((F.col("f") == "R") & (i % 5 == 0)).alias("is_suspended"),
    )


@query(f"WITH {_MARKET}, {_LIMITS} SELECT instrument_id, trade_date, limit_group, status, preclose_ticks, upper_ticks, lower_ticks FROM limited")
def price_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.price_limits(_market(spark, sf_dir)).select("instrument_id", "trade_date", "limit_group", "status", "preclose_ticks", "upper_ticks", "lower_ticks")


@query(
    f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'ETF' ELSE 'STOCK' END AS fee_group, ['SSE', 'SZSE', 'BSE'][1 + o_custkey % 3] AS exchange, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(o_orderdate AS DATE) + 5500 AS trade_date, CAST(round(o_totalprice * 100) AS BIGINT) AS gross, o_custkey * 100 AS quantity FROM orders),
s AS (SELECT side, CAST(a AS DATE) AS a, coalesce(CAST(z AS DATE), DATE '9999-12-31') AS z, CAST(rate AS DECIMAL(12, 8)) AS rate FROM {_values(rules.STAMP_DUTY, "side, a, z, rate")}), t AS (SELECT exchange, CAST(a AS DATE) AS a, coalesce(CAST(z AS DATE), DATE '9999-12-31') AS z, basis, CAST(rate AS DECIMAL(12, 8)) AS rate FROM {_values(rules.TRANSFER_FEE, "exchange, a, z, basis, rate")}),
p AS (SELECT f.*, greatest(CAST(round(CAST(gross AS DECIMAL(18, 0)) * 0.0003, 0) AS BIGINT), 500) AS commission, CASE WHEN fee_group = 'STOCK' THEN coalesce(CAST(round(CAST(gross AS DECIMAL(18, 0)) * s.rate, 0) AS BIGINT), 0) ELSE 0 END AS stamp_duty,
  CASE WHEN fee_group = 'STOCK' THEN coalesce(CAST(round(CAST(CASE WHEN basis = 'face_value' THEN quantity * 100 ELSE gross END AS DECIMAL(18, 0)) * t.rate, 0) AS BIGINT), 0) ELSE 0 END AS transfer_fee
  FROM f LEFT JOIN s ON s.side = f.side AND f.trade_date BETWEEN s.a AND s.z LEFT JOIN t ON t.exchange = f.exchange AND f.trade_date BETWEEN t.a AND t.z)
SELECT o_orderkey, commission, stamp_duty, transfer_fee, commission + stamp_duty + transfer_fee AS total_fees FROM p"""
)
def trade_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    exchange = F.element_at(F.array(F.lit("SSE"), F.lit("SZSE"), F.lit("BSE")), (c % 3 + 1).cast("int"))
    fills = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "ETF").otherwise("STOCK").alias("fee_group"), exchange.alias("exchange"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.date_add(F.col("o_orderdate").cast("date"), 5500).alias("trade_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gross_cents"), (c * 100).alias("quantity"),
    )
    return rules.fees(fills).select("o_orderkey", "commission", "stamp_duty", "transfer_fee", "total_fees")


@query(
    """SELECT s_suppkey AS instrument_id, 'STOCK_' || b AS profile, CASE b WHEN 'STAR' THEN 200 ELSE 100 END AS buy_minimum, CASE WHEN b IN ('STAR', 'BSE') THEN 1 ELSE 100 END AS buy_increment,
CASE b WHEN 'STAR' THEN s_suppkey * 20 >= 200 WHEN 'BSE' THEN s_suppkey * 20 >= 100 ELSE s_suppkey * 20 >= 100 AND s_suppkey * 20 % 100 = 0 END AS allowed FROM (SELECT s_suppkey, ['MAIN', 'CHINEXT', 'STAR', 'BSE'][1 + s_suppkey % 4] AS b FROM supplier)"""
)
def trading_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    board = F.element_at(F.array(*[F.lit(x) for x in ("MAIN", "CHINEXT", "STAR", "BSE")]), (i % 4 + 1).cast("int"))
    rows = rules.with_profile(load(spark, sf_dir, "supplier").select(i.cast("string").alias("instrument_id"), F.lit("STOCK").alias("instrument_type"), board.alias("board")))
    number = F.col("instrument_id").cast("long")
    return rows.select(number.alias("instrument_id"), "profile", F.col("buy_minimum").cast("int").alias("buy_minimum"), F.col("buy_increment").cast("int").alias("buy_increment"), rules.allowed_quantity(F.lit("BUY"), number * 20, F.lit(0)).alias("allowed"))


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market with the day's range and each name's trading profile."""
    m = _market(spark, sf_dir)
    profiles = spark.createDataFrame([p[2:6] + p[7:8] for p in rules.PROFILES if p[0].startswith("STOCK")], "buy_minimum long, buy_increment long, sell_minimum long, sell_increment long, limit_group string")
    width = F.col("instrument_id") % 50
    return m.withColumns({"low_ticks": F.col("open_ticks") - width, "high_ticks": F.col("open_ticks") + width}).join(F.broadcast(profiles), "limit_group")  # four rows


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one book for each supplier, dealt by name and day as the market that they meet is."""
    li = load(spark, sf_dir, "lineitem").withColumn("trade_date", F.date_add(F.col("l_shipdate").cast("date"), 4000)).repartition("l_suppkey", "trade_date")
    return li.groupBy(F.col("l_suppkey").alias("run_id"), "trade_date", F.col("l_suppkey").alias("instrument_id"), F.when(F.col("l_linenumber") <= 4, "BUY").otherwise("SELL").alias("side")).agg((F.sum("l_quantity").cast("long") * 10).alias("quantity"))


@query(
    f"""WITH {_MARKET}, {_LIMITS}, prof(limit_group, bmin, binc, smin, sinc) AS (VALUES ('MAIN', 100, 100, 100, 100), ('CHINEXT', 100, 100, 100, 100), ('STAR', 200, 1, 200, 1), ('BSE', 100, 1, 100, 1)),
o AS (SELECT l_orderkey AS run_id, CAST(l_shipdate AS DATE) + CASE WHEN l_orderkey % 40 = 0 THEN 9000 ELSE 4000 END AS trade_date, l_suppkey AS instrument_id, CASE WHEN l_orderkey % 37 = 0 THEN 'SHORT_OPEN' WHEN l_linenumber <= 4 THEN 'BUY' ELSE 'SELL' END AS side, CAST(l_quantity AS BIGINT) * CASE WHEN l_orderkey % 3 = 0 THEN 10 ELSE 100 END AS quantity, CASE WHEN l_orderkey % 6 = 0 THEN 0 WHEN l_orderkey % 5 = 0 THEN 350 ELSE 100000 END AS sellable FROM lineitem),
j AS (SELECT o.*, l.* EXCLUDE (instrument_id, trade_date), open_ticks - o.instrument_id % 50 AS low_ticks, open_ticks + o.instrument_id % 50 AS high_ticks, bmin, binc, smin, sinc, coalesce(CAST(floor(CASE WHEN o.instrument_id % 13 = 0 THEN 9 ELSE volume END * 0.1) AS BIGINT), 0) AS capacity, CAST(round(CAST(open_ticks AS DECIMAL(18, 0)) * CASE WHEN side = 'BUY' THEN 1.0005 ELSE 0.9995 END, 0) AS BIGINT) AS p FROM o LEFT JOIN limited l USING (instrument_id, trade_date) LEFT JOIN prof USING (limit_group)),
c AS (SELECT *, CASE side WHEN 'BUY' THEN least(quantity, capacity) WHEN 'SELL' THEN least(quantity, capacity, sellable) END AS most, CASE side WHEN 'BUY' THEN quantity >= bmin AND (quantity - bmin) % binc = 0 WHEN 'SELL' THEN (quantity >= smin AND (quantity - smin) % sinc = 0) OR (quantity = sellable AND sellable > 0) END AS fits FROM j),
n AS (SELECT *, CASE WHEN limit_group IS NULL THEN NULL WHEN side = 'BUY' THEN CASE WHEN most >= bmin THEN most - (most - bmin) % binc ELSE 0 END WHEN side = 'SELL' THEN CASE WHEN most = sellable AND sellable > 0 THEN most WHEN most >= smin THEN most - (most - smin) % sinc ELSE 0 END END AS candidate FROM c)
SELECT run_id, trade_date, instrument_id, side, quantity, CASE WHEN side IN ('BUY', 'SELL') THEN least(greatest(p, coalesce(lower_ticks, p)), coalesce(upper_ticks, p)) END AS price_ticks, capacity, candidate,
CASE WHEN is_suspended THEN 'SUSPENDED' WHEN open_ticks IS NULL THEN 'NO_MARKET_DATA' WHEN side LIKE 'SHORT%' THEN 'SHORT_NOT_SUPPORTED' WHEN NOT fits THEN 'ODD_LOT' WHEN side = 'BUY' AND low_ticks >= upper_ticks THEN 'LIMIT_UP_BUY_BLOCKED' WHEN side = 'SELL' AND high_ticks <= lower_ticks THEN 'LIMIT_DOWN_SELL_BLOCKED'
WHEN side = 'SELL' AND sellable = 0 THEN 'INSUFFICIENT_SELLABLE' WHEN capacity = 0 THEN 'VOLUME_CAP' WHEN candidate = 0 AND side = 'SELL' THEN 'INSUFFICIENT_SELLABLE' WHEN candidate = 0 THEN 'VOLUME_CAP' END AS market_reason FROM n"""
)
def execution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with what it may sell: all reasons occur."""
    k = F.col("l_orderkey")
    side = F.when(k % 37 == 0, "SHORT_OPEN").when(F.col("l_linenumber") <= 4, "BUY").otherwise("SELL")
    size = F.col("l_quantity").cast("long") * F.when(k % 3 == 0, 10).otherwise(100)
    sellable = F.when(k % 6 == 0, 0).when(k % 5 == 0, 350).otherwise(100000).cast("long")
    day = F.date_add(F.col("l_shipdate").cast("date"), F.when(k % 40 == 0, 9000).otherwise(4000))
    orders = load(spark, sf_dir, "lineitem").select(k.alias("run_id"), day.alias("trade_date"), F.col("l_suppkey").alias("instrument_id"), side.alias("side"), size.alias("quantity"), sellable.alias("sellable"))
    market = _traded(spark, sf_dir).withColumn("volume", F.when(F.col("instrument_id") % 13 == 0, 9).otherwise(F.col("volume")).cast("long"))
    return backtest.prepared_orders(orders, market)


@query()
def backtest_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each supplier, folded through the ledger."""
    return backtest.run_backtests(backtest.prepared_orders(_orders(spark, sf_dir), _traded(spark, sf_dir)), 100_000_000)


@query()
def backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = _traded(spark, sf_dir)
    fills = backtest.run_backtests(backtest.prepared_orders(_orders(spark, sf_dir), market), 100_000_000)
    return backtest.marked_to_market(fills, market.select("trade_date", "instrument_id", F.col("open_ticks").alias("close_ticks")), 100_000_000)


@query(f"WITH {BARS} SELECT instrument_id, trade_date, round(close / lag(close) OVER o - 1, 8) AS return_1, round(close / lag(close, 5) OVER o - 1, 8) AS return_5, round(close / lag(close, 20) OVER o - 1, 8) AS return_20, round((high - low) / lag(close) OVER o, 8) AS amplitude, round(close / first_value(close) OVER o * 100, 6) AS rebased FROM bars WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date)")
def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.index_panel(bars(spark, sf_dir))
    return out.select("instrument_id", "trade_date", *[F.round(c, 8).alias(c) for c in ("return_1", "return_5", "return_20", "amplitude")], F.round("rebased", 6).alias("rebased"))


@query(
    f"""WITH {BARS}, t AS (SELECT trade_date, sum(amount) AS amount FROM bars GROUP BY 1), l AS (SELECT *, list(round(amount, 2)) OVER (ORDER BY trade_date ROWS 19 PRECEDING) AS last FROM t)
SELECT trade_date, round(amount, 2) AS amount, round(amount / lag(amount) OVER (ORDER BY trade_date) - 1, 8) AS change, round(avg(amount) OVER (ORDER BY trade_date ROWS 4 PRECEDING), 4) AS average_5, round(avg(amount) OVER (ORDER BY trade_date ROWS 19 PRECEDING), 4) AS average_20, round(len(list_filter(last, lambda x: x <= round(amount, 2))) / len(last), 8) AS percentile_20 FROM l"""
)
def market_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.liquidity(bars(spark, sf_dir))
    return out.select("trade_date", F.round("amount", 2).alias("amount"), F.round("change", 8).alias("change"), *[F.round(c, 4).alias(c) for c in ("average_5", "average_20")], F.round("percentile_20", 8).alias("percentile_20"))


_CHANGES = f"WITH {RETURNS}, ch AS (SELECT trade_date, instrument_id, (close / preclose - 1) * 100 AS change, amount, 'n' || CAST(instrument_id % 8 AS VARCHAR) AS industry FROM ret)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("trade_date", "instrument_id", ((F.col("close") / F.col("preclose") - 1) * 100).alias("change"), "amount", F.concat(F.lit("n"), (F.col("instrument_id") % 8).cast("string")).alias("industry"))


_BUCKETS = ", ".join(["count(*) FILTER (WHERE change < -7) AS bucket_0", *(f"count(*) FILTER (WHERE change >= {a} AND change < {b}) AS bucket_{i}" for i, (a, b) in enumerate(zip(review.EDGES, review.EDGES[1:]), 1)), "count(*) FILTER (WHERE change >= 7) AS bucket_7"])
_PERCENTILES = ", ".join(f"round(quantile_cont(change, {p / 100}), 5) AS p{p:02d}" for p in (5, 25, 50, 75, 95))


@query(f"{_CHANGES} SELECT trade_date, count(*) FILTER (WHERE change > 0) AS up, count(*) FILTER (WHERE change < 0) AS down, count(*) FILTER (WHERE change = 0) AS flat, {_PERCENTILES}, {_BUCKETS} FROM ch GROUP BY 1")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.breadth(_changes(spark, sf_dir)), 5)


@query(
    f"""WITH {_MARKET}, {_LIMITS}, b AS (SELECT *, open_ticks + 30 AS high_ticks, open_ticks - 30 AS low_ticks, open_ticks + (instrument_id % 3 - 1) * 20 AS close_ticks FROM limited),
s AS (SELECT *, CASE WHEN upper_ticks IS NULL THEN NULL WHEN close_ticks >= upper_ticks AND low_ticks >= upper_ticks AND open_ticks >= upper_ticks THEN 'ONE' WHEN close_ticks >= upper_ticks THEN 'UP' WHEN close_ticks <= lower_ticks THEN 'DOWN' WHEN high_ticks >= upper_ticks THEN 'BROKEN' END AS st FROM b)
SELECT trade_date, count(*) FILTER (WHERE st IN ('ONE', 'UP')) AS limit_up, count(*) FILTER (WHERE st = 'ONE') AS one_price, count(*) FILTER (WHERE st = 'DOWN') AS limit_down, count(*) FILTER (WHERE st = 'BROKEN') AS broken, count(*) FILTER (WHERE upper_ticks IS NULL) AS unresolved FROM s GROUP BY 1"""
)
def limit_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rules.price_limits(_market(spark, sf_dir))
    o = F.col("open_ticks")
    return review.limit_sentiment(m.withColumns({"high_ticks": o + 30, "low_ticks": o - 30, "close_ticks": o + (F.col("instrument_id") % 3 - 1) * 20}))


@query(f"{_CHANGES}, s AS (SELECT trade_date, industry, count(change) AS members, avg(change) AS mean_change, count(*) FILTER (WHERE change > 0) / count(change) AS advance_rate, sum(amount) AS amount FROM ch GROUP BY 1, 2) SELECT trade_date, industry, members, round(mean_change, 5) AS mean_change, round(CASE WHEN members > 0 THEN advance_rate END, 8) AS advance_rate, round(amount, 2) AS amount, round(amount / sum(amount) OVER (PARTITION BY trade_date), 8) AS amount_share FROM s")
def industry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.industry_table(_changes(spark, sf_dir))
    return out.select("trade_date", "industry", "members", F.round("mean_change", 5).alias("mean_change"), F.round("advance_rate", 8).alias("advance_rate"), F.round("amount", 2).alias("amount"), F.round("amount_share", 8).alias("amount_share"))


@query("SELECT c_nationkey, count(c_acctbal) FILTER (WHERE c_acctbal > 0) AS n_values, " + ", ".join(f"round(quantile_cont(c_acctbal, {p / 100}) FILTER (WHERE c_acctbal > 0), 5) AS p{p:02d}" for p in (10, 25, 50, 75, 90)) + " FROM customer GROUP BY 1")
def valuation_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.valuation(load(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"]), 5)


@query(
    """WITH d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT k, d, row_number() OVER w AS n, lead(d) OVER w AS later FROM d WINDOW w AS (PARTITION BY k ORDER BY d)),
t AS (SELECT k, CASE WHEN n = 1 AND k % 3 <> 0 THEN DATE '2005-01-24' - 7000 ELSE d END AS s, CASE WHEN later IS NULL THEN CASE WHEN k % 7 = 0 THEN DATE '2030-01-01' ELSE DATE '9999-12-31' END ELSE later - 1 - CASE WHEN dayofmonth(d) = 9 THEN 1 ELSE 0 END END AS e FROM r),
x AS (SELECT *, lead(s) OVER w AS next, row_number() OVER w = 1 AS first FROM t WINDOW w AS (PARTITION BY k ORDER BY s))
SELECT k, s AS rule_start FROM x WHERE CASE WHEN next IS NULL THEN e <> DATE '9999-12-31' ELSE e + 1 <> next END OR (first AND s <> DATE '2005-01-24' - 7000)"""
)
def rule_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals between the orders of each customer as dated rules: keys that begin late, leave a gap or end."""
    k, day = F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d")
    w = Window.partitionBy("k").orderBy("d")
    r = load(spark, sf_dir, "orders").select(k, day).distinct().withColumns({"n": F.row_number().over(w), "later": F.lead("d").over(w)})
    first = F.date_sub(F.lit(rules.RULES_START).cast("date"), 7000)
    ends = F.when(F.col("k") % 7 == 0, F.lit("2030-01-01")).otherwise(F.lit("9999-12-31")).cast("date")
    until = F.when(F.col("later").isNull(), ends).otherwise(F.date_sub("later", F.when(F.dayofmonth("d") == 9, 2).otherwise(1)))
    table = r.select("k", F.when((F.col("n") == 1) & (F.col("k") % 3 != 0), first).otherwise(F.col("d")).alias("rule_start"), until.alias("rule_end"))
    return rules.broken_intervals(table, ["k"], first)
