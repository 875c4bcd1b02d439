"""Queries of lots, pursued targets, look-backs and histories too long for one task (L2, G7, F1, J6, J7, W8-W10) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import decisions, factors, lots, scan
from panelspark.plans.decisions import _NAV, _nav
from panelspark.plans.more import _EVENTS, _known
from panelspark.plans.pit import _LEFT, _RIGHT, _sides
from panelspark.plans.tables import load, query

#: Rows of a range in these queries; a cluster takes scan.ROWS.
_ROWS = 20_000

_LOTS = "lots AS (SELECT CAST(l_linenumber AS INTEGER) AS run_id, l_suppkey % 100 AS instrument_id, l_orderkey AS lot, CAST(l_shipdate AS DATE) AS buy_date, CAST(l_shipdate AS DATE) + 1 AS sellable_date, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents FROM lineitem)"


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each line number, a lot for each line."""
    day = F.col("l_shipdate").cast("date")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("run_id"), (F.col("l_suppkey") % 100).alias("instrument_id"), F.col("l_orderkey").alias("lot"), day.alias("buy_date"), F.date_add(day, 1).alias("sellable_date"),
        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost_cents"),
    )


@query(
    f"""WITH RECURSIVE {_EVENTS}, {_LOTS}, act AS (SELECT instrument_id, revision AS event_id, record_date, record_date + 1 AS ex_date, record_date + 3 AS listing_date, stock_per_share AS per, 0 AS split FROM known WHERE revision % 9 <> 0
  UNION ALL SELECT instrument_id, revision, record_date, record_date, record_date, 2.0::DOUBLE, 1 FROM known WHERE revision % 9 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY run_id, instrument_id ORDER BY until, event_id) AS i FROM (SELECT act.*, r.run_id, CASE WHEN split = 1 THEN ex_date - 1 ELSE record_date END AS until FROM act JOIN (SELECT DISTINCT run_id, instrument_id FROM lots) r USING (instrument_id))),
b AS (SELECT a.*, coalesce((SELECT CAST(sum(quantity) AS BIGINT) FROM lots l WHERE l.run_id = a.run_id AND l.instrument_id = a.instrument_id AND l.buy_date <= a.until), 0) AS bought FROM a),
f(run_id, instrument_id, i, done) AS (
  SELECT run_id, instrument_id, 1, [{{'e': event_id, 'ex': ex_date, 'l': listing_date, 'n': CAST(CASE WHEN bought > 0 THEN floor(bought * per) - split * bought ELSE 0 END AS BIGINT)}}] FROM b WHERE i = 1
  UNION ALL
  SELECT run_id, instrument_id, i, list_append(done, {{'e': event_id, 'ex': ex_date, 'l': listing_date, 'n': CAST(CASE WHEN h > 0 THEN floor(h * per) - split * h ELSE 0 END AS BIGINT)}})
  FROM (SELECT b.*, f.done, bought + coalesce(CAST(list_sum(list_transform(list_filter(f.done, lambda x: x.ex <= CASE WHEN b.split = 1 THEN b.ex_date ELSE b.record_date END), lambda x: x.n)) AS BIGINT), 0) AS h FROM f JOIN b ON b.run_id = f.run_id AND b.instrument_id = f.instrument_id AND b.i = f.i + 1)),
n AS (SELECT run_id, instrument_id, unnest(done) AS x FROM f QUALIFY i = max(i) OVER (PARTITION BY run_id, instrument_id)),
e AS (SELECT run_id, instrument_id, max(x.ex) AS last_ex FROM n WHERE x.n <> 0 GROUP BY 1, 2),
u AS (SELECT run_id, instrument_id, 'BUY' AS kind, lot, buy_date, sellable_date, quantity, cost_cents FROM lots UNION ALL SELECT run_id, instrument_id, 'STOCK', x.e, x.ex, x.l, x.n, 0 FROM n WHERE x.n <> 0),
v AS (SELECT u.*, coalesce(kind = 'STOCK' OR buy_date < last_ex, false) AS lived FROM u LEFT JOIN e USING (run_id, instrument_id)),
w AS (SELECT *, CAST((sum(cost_cents) OVER g * quantity) // sum(quantity) OVER g AS BIGINT) AS part, CAST(sum(cost_cents) OVER g AS BIGINT) AS total, row_number() OVER (g ORDER BY buy_date DESC, sellable_date DESC, kind DESC, lot DESC) = 1 AS last FROM v WINDOW g AS (PARTITION BY run_id, instrument_id, lived))
SELECT run_id, instrument_id, kind, lot, buy_date, sellable_date, quantity, CAST(CASE WHEN NOT lived THEN cost_cents WHEN last THEN total - (sum(part) OVER (PARTITION BY run_id, instrument_id, lived) - part) ELSE part END AS BIGINT) AS cost_cents FROM w"""
)
def lots_after_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lots of all runs under stock dividends and two-for-one splits (L2)."""
    known = _known(spark, sf_dir).select("instrument_id", F.col("revision").alias("event_id"), "record_date", "ex_date", "listing_date", F.col("stock_per_share").alias("stock_per_share"))
    split = F.col("event_id") % 9 == 0
    day = lambda c: F.when(split, F.col("record_date")).otherwise(F.col(c)).alias(c)
    acts = known.select("instrument_id", "event_id", "record_date", day("ex_date"), day("listing_date"), F.when(split, "FUND_SPLIT").otherwise("DIVIDEND").alias("action_type"), F.when(split, 2.0).otherwise(F.col("stock_per_share")).alias("stock_per_share"))
    return lots.after_actions(_lots(spark, sf_dir), acts)


_SHARES = """q AS (SELECT s_nationkey AS portfolio_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, l_suppkey AS instrument_id, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
h AS (SELECT portfolio_id, trade_date, instrument_id, q::DOUBLE / sum(q) OVER (PARTITION BY portfolio_id, trade_date)::DOUBLE AS weight FROM q),
t AS (SELECT portfolio_id, trade_date, instrument_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio_id, trade_date) AS weight FROM q WHERE month(trade_date) IN (2, 3, 9))"""


@query(
    f"""WITH RECURSIVE {_SHARES}, s AS (SELECT portfolio_id, trade_date, row_number() OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS i, trade_date IN (SELECT trade_date FROM t WHERE t.portfolio_id = d.portfolio_id) AS new FROM (SELECT DISTINCT portfolio_id, trade_date FROM h) d),
l AS (SELECT *, max(CASE WHEN new THEN trade_date END) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS proposal_date FROM s),
g AS (SELECT portfolio_id, trade_date, max(abs(w)) AS largest_gap FROM (
  SELECT portfolio_id, trade_date, instrument_id, sum(weight) - sum(target) AS w FROM (
    SELECT l.portfolio_id, l.trade_date, t.instrument_id, 0.0::DOUBLE AS weight, t.weight AS target FROM l JOIN t ON t.portfolio_id = l.portfolio_id AND t.trade_date = l.proposal_date
    UNION ALL SELECT l.portfolio_id, l.trade_date, h.instrument_id, h.weight, 0.0::DOUBLE FROM l JOIN h ON h.portfolio_id = l.portfolio_id AND h.trade_date = l.trade_date WHERE l.proposal_date IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2),
r AS (SELECT l.*, largest_gap FROM l LEFT JOIN g USING (portfolio_id, trade_date)),
f(portfolio_id, i, active, state) AS (
  SELECT portfolio_id, i, new AND largest_gap > 0.08, CASE WHEN NOT new THEN 'IDLE' WHEN largest_gap > 0.08 THEN 'PURSUED' ELSE 'REACHED' END FROM r WHERE i = 1
  UNION ALL
  SELECT r.portfolio_id, r.i, (r.new OR f.active) AND largest_gap > 0.08, CASE WHEN NOT (r.new OR f.active) THEN 'IDLE' WHEN largest_gap > 0.08 THEN 'PURSUED' ELSE 'REACHED' END FROM f JOIN r ON r.portfolio_id = f.portfolio_id AND r.i = f.i + 1)
SELECT r.portfolio_id, r.trade_date, r.proposal_date, round(r.largest_gap, 9) AS largest_gap, f.state FROM f JOIN r ON r.portfolio_id = f.portfolio_id AND r.i = f.i"""
)
def pursued_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios are nations, weights the shares of what their suppliers ship; equal weights are proposed in three months of a year."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("portfolio_id"))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").alias("trade_date")
    q = load(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("portfolio_id", month, F.col("l_suppkey").alias("instrument_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    sums = q.groupBy("portfolio_id", "trade_date").agg(F.sum("q").alias("all_q"), F.count("*").alias("n"))
    rows = q.join(sums, ["portfolio_id", "trade_date"])
    held = rows.select("portfolio_id", "trade_date", "instrument_id", (F.col("q").cast("double") / F.col("all_q").cast("double")).alias("weight"))
    proposed = rows.where(F.month("trade_date").isin(2, 3, 9)).select("portfolio_id", "trade_date", "instrument_id", (F.lit(1.0) / F.col("n")).alias("weight"))
    out = decisions.pursued_targets(held.select("portfolio_id", "trade_date"), proposed, held, 0.08)
    return out.withColumn("largest_gap", F.round("largest_gap", 9))


@query(f"WITH {_LEFT}, {_RIGHT}, x AS (SELECT d, max(v) AS v FROM r GROUP BY d) SELECT l.k, l.d, x.d AS d_matched, x.v FROM l ASOF LEFT JOIN x ON l.d >= x.d")
def asof_one_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of join with one key for all rows, its history cut into ranges."""
    left, right = _sides(spark, sf_dir)
    every = lambda df: df.withColumn("one", F.lit(1))
    days = right.groupBy("d").agg(F.max("v").alias("v"))
    return scan.asof_backward_ranges(every(left), every(days), ["one"], "d", ["v"], rows=_ROWS).drop("one")


@query(f"WITH {_LEFT}, {_RIGHT} SELECT l.k, l.d, r.d AS d_matched, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d > r.d")
def asof_strict_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return scan.asof_backward_ranges(left, right, ["k"], "d", ["v"], strict=True, rows=_ROWS)


@query(
    """SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS shipped, max(l_extendedprice) OVER w AS dearest, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 END) OVER w AS BIGINT) AS returned FROM lineitem
WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag ROWS UNBOUNDED PRECEDING)"""
)
def running_one_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums and a running maximum over all lines in order of shipment, without one task for all."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    out = scan.running(rows, [], "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"], {"shipped": F.col("l_quantity").cast("long"), "returned": F.when(F.col("l_returnflag") == "R", F.lit(1).cast("long"))}, {"dearest": F.col("l_extendedprice")}, rows=_ROWS)
    return out.select("l_orderkey", "l_linenumber", "shipped", "dearest", "returned")


def _session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolios of `_nav` as instruments of daily returns."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = _nav(spark, sf_dir).select(F.col("portfolio_id").alias("instrument_id"), "trade_date", "equity")
    r = F.ln(F.col("equity").cast("double")) - F.ln(F.lag("equity").over(w).cast("double"))
    return rows.select("instrument_id", "trade_date", F.when(F.col("equity") > 0, r).alias("log_return"), F.col("trade_date").cast("timestamp_ntz").alias("available_at"))


def _look_back_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT trade_date AS signal_date, instrument_id, 'return_{n}d' AS factor_id, CASE WHEN i > {n} AND count(r) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS {n - 1} PRECEDING) = {n} THEN round(exp(sum(r) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS {n - 1} PRECEDING)) - 1, 7) END AS value,
CASE WHEN i <= {n} THEN 'INSUFFICIENT_HISTORY' WHEN count(r) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS {n - 1} PRECEDING) < {n} THEN 'NONFINITE_VALUE' END AS invalid_reason FROM r"""
        for n in (20, 60, 120)
    )
    return f"WITH {_NAV}, l AS (SELECT *, lag(equity) OVER w AS before, row_number() OVER w AS i FROM nav WINDOW w AS (PARTITION BY portfolio_id ORDER BY trade_date)), r AS (SELECT portfolio_id AS instrument_id, trade_date, i, CASE WHEN equity > 0 AND before > 0 THEN ln(equity::DOUBLE) - ln(before::DOUBLE) END AS r FROM l) {parts}"


@query(_look_back_sql())
def factor_return_20_60_120d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over 20, 60 and 120 sessions (F1)."""
    panel, out = _session_returns(spark, sf_dir), None
    for n in (20, 60, 120):
        one = factors.market_factor(f"return_{n}d", factors.period_return(n), n + 1)(panel)
        one = one.select("signal_date", "instrument_id", "factor_id", F.round("value", 7).alias("value"), "invalid_reason")
        out = one if out is None else out.unionByName(one)
    return out
