"""Queries of point-in-time reads, joins and top-k (S*, P*, J*, T*, A*, D*) over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import any_true, first_reason, is_finite, mapped
from panelspark.operators import prices, reads, relational
from panelspark.operators import windows as win
from panelspark.plans.tables import BARS, RETURNS, bars, load, query, returns

_LEFT = "l AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem)"
_RIGHT = "r AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, CASE WHEN count(*) > 1 THEN sum(CAST(l_quantity AS BIGINT)) END AS v FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2 GROUP BY 1, 2)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = load(spark, sf_dir, "lineitem").withColumns({"k": F.col("l_suppkey"), "d": F.col("l_shipdate").cast("date")})
    right = li.where("l_returnflag = 'R' and l_linenumber <= 2").groupBy("k", "d").agg(F.when(F.count("*") > 1, F.sum(F.col("l_quantity").cast("long"))).alias("v"))
    return li.select("k", "d").distinct(), right


@query(f"WITH {_LEFT}, {_RIGHT} SELECT l.k, l.d, r.d AS d_matched, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d >= r.d")
def asof_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return relational.asof_backward(left, right, ["k"], "d", ["v"])


@query(f"WITH {_LEFT}, {_RIGHT} SELECT l.k, l.d, r.d AS d_matched, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.d > r.d")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return relational.asof_backward(left, right, ["k"], "d", ["v"], strict=True)


_MEMBERS = """members AS (
  SELECT o_custkey % 60 AS instrument_id, CAST(o_orderdate AS DATE) AS in_date, CAST(o_orderdate AS DATE) + 3 AS in_known, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 200 END AS out_date,
         CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 210 END AS out_known, o_orderpriority AS code, o_orderkey AS id FROM orders),
dates AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, CAST(date_trunc('quarter', o_orderdate) AS DATE) + 1 AS cutoff FROM orders)"""


@query(
    f"""WITH {_MEMBERS} SELECT d.date, m.instrument_id, m.code, m.in_date, m.id FROM members m JOIN dates d
ON m.in_date <= d.date AND m.in_known <= d.cutoff AND NOT (m.out_date IS NOT NULL AND m.out_date <= d.date AND m.out_known IS NOT NULL AND m.out_known <= d.cutoff)
QUALIFY row_number() OVER (PARTITION BY d.date, m.instrument_id ORDER BY m.in_date DESC, m.in_known DESC, m.code, m.id) = 1"""
)
def interval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, n = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    members = load(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 60).alias("instrument_id"), day.alias("in_date"), F.date_add(day, 3).alias("in_known"), F.when(n % 3 != 0, F.date_add(day, 200)).alias("out_date"),
        F.when((n % 3 != 0) & (n % 4 != 0), F.date_add(day, 210)).alias("out_known"), F.col("o_orderpriority").alias("code"), n.alias("id"),
    )
    quarter = F.trunc(day, "quarter")
    dates = load(spark, sf_dir, "orders").select(quarter.alias("date"), F.date_add(quarter, 1).alias("cutoff")).distinct()
    order = [F.col("in_date").desc(), F.col("in_known").desc(), F.col("code"), F.col("id")]
    out = relational.interval_state(members, dates, "instrument_id", "in_date", "out_date", "cutoff", "in_known", "out_known", order)
    return out.select("date", "instrument_id", "code", "in_date", "id")


_REVISIONS = "revisions AS (SELECT o_custkey AS k, CAST(date_trunc('year', o_orderdate) AS DATE) AS period, CAST(o_orderdate AS TIMESTAMP) AS available_at, o_orderkey AS revision, o_totalprice AS v, o_orderstatus <> 'P' AS pit_usable FROM orders)"


@query(f"WITH {_REVISIONS} SELECT k, period, available_at, revision, v FROM revisions WHERE pit_usable AND available_at <= TIMESTAMP '1998-06-30' QUALIFY row_number() OVER (PARTITION BY k, period ORDER BY available_at DESC, revision DESC) = 1")
def latest_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.trunc(day, "year").alias("period"), F.col("o_orderdate").cast("timestamp_ntz").alias("available_at"), F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") != "P").alias("pit_usable"))
    return relational.latest_visible(rows, ["k", "period"], F.expr("timestamp_ntz'1998-06-30 00:00:00'")).select("k", "period", "available_at", "revision", "v")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (3, 7, 11, 19) AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def instrument_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projected read of some instruments in an inclusive range (S2-S7, P2, P3): both filters reach the scan."""
    li = load(spark, sf_dir, "lineitem")
    day = (F.col("l_shipdate") >= F.expr("timestamp_ntz'1996-01-01 00:00:00'")) & (F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01 00:00:00'"))
    return li.where(F.col("l_suppkey").isin(3, 7, 11, 19) & day).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' AND value < 1 THEN 'SMALL_CLICK' WHEN user_id % 10 = 0 THEN 'TENTH_USER' WHEN value > 50 OR hour(ts) = 0 THEN 'LARGE_OR_MIDNIGHT' END AS reason,
CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE -1 END AS code, greatest(value, user_id) AS larger, least(value, user_id) AS smaller, regexp_matches(event_type, '^[cv]') AS matched FROM events"""
)
def reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by precedence, row-wise any, largest and smallest, mapping and a pattern."""
    e = load(spark, sf_dir, "events")
    reason = first_reason(
        ((F.col("event_type") == "click") & is_finite("value") & (F.col("value") < 1), "SMALL_CLICK"), (F.col("user_id") % 10 == 0, "TENTH_USER"),
        (any_true([F.col("value") > 50, F.hour("ts") == 0]), "LARGE_OR_MIDNIGHT"),
    )
    wide = F.col("user_id").cast("double")
    return e.select("event_id", reason.alias("reason"), mapped("event_type", {"click": 1, "view": 2}, -1).alias("code"), F.greatest("value", wide).alias("larger"), F.least("value", wide).alias("smaller"), F.col("event_type").rlike("^[cv]").alias("matched"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query("SELECT s.s_suppkey, s.s_acctbal, n.n_name FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON n.n_nationkey = s.s_nationkey")
def checked_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.left_join_checked(load(spark, sf_dir, "supplier"), nations, ["s_nationkey"]).select("s_suppkey", "s_acctbal", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("SELECT s_nationkey, s_suppkey, s_acctbal, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank FROM supplier QUALIFY rank <= 3")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_n(load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], 3, "s_acctbal", "s_suppkey")


@query(
    """WITH s AS (SELECT year(l_shipdate) AS y, l_suppkey, sum(CAST(l_quantity AS BIGINT) - 25) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(q) DESC, l_suppkey) AS n FROM s)
SELECT CAST(y AS INTEGER) AS y, CASE WHEN n <= 20 THEN CAST(l_suppkey AS VARCHAR) ELSE 'OTHER' END AS bucket, CAST(sum(q) AS BIGINT) AS q, count(*) AS n_names FROM r GROUP BY 1, 2"""
)
def top_and_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), "l_suppkey", (F.col("l_quantity").cast("long") - 25).alias("q"))
    return relational.top_and_other(rows, ["y"], "l_suppkey", "q", 20)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.page(rows, [F.col("o_totalprice").desc(), "o_orderkey"], 3, 25)


@query(f"WITH {BARS} SELECT DISTINCT trade_date FROM bars WHERE trade_date <= DATE '1998-06-15' ORDER BY 1 DESC LIMIT 21")
def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_sessions(bars(spark, sf_dir).select("trade_date").distinct(), F.lit("1998-06-15").cast("date"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_index, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1 AS is_first FROM lineitem")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    return relational.first_flag(relational.row_index(rows, order, ["l_suppkey"]), ["l_suppkey"], order).drop("l_shipdate")


@query("SELECT s_nationkey, array_to_string(list_sort(list_distinct(list(s_suppkey % 7))), ',') AS codes FROM supplier GROUP BY 1")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).alias("c"))
    return relational.sorted_distinct(rows, ["s_nationkey"], "c", "codes").select("s_nationkey", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


_FACTORS = """fac AS (SELECT l_suppkey AS instrument_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS trade_date, CAST(1 + max(l_linenumber) * 0.5 + l_suppkey % 3 AS DOUBLE) AS adjustment_factor FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_suppkey").alias("instrument_id"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("trade_date"))
    return rows.agg(F.max("l_linenumber").alias("m")).select("instrument_id", "trade_date", (F.lit(1.0) + F.col("m") * 0.5 + F.col("instrument_id") % 3).alias("adjustment_factor"))


@query(
    f"""WITH {RETURNS}, {_FACTORS}, e AS (SELECT instrument_id, arg_max(adjustment_factor, trade_date) AS f_end FROM fac GROUP BY 1),
b AS (SELECT * FROM ret WHERE NOT (volume = 0 AND amount = 0)), x AS (SELECT b.*, f.adjustment_factor AS f FROM b ASOF LEFT JOIN fac f ON b.instrument_id = f.instrument_id AND b.trade_date >= f.trade_date),
y AS (SELECT x.*, p.adjustment_factor AS f_prev FROM x ASOF LEFT JOIN fac p ON x.instrument_id = p.instrument_id AND x.trade_date > p.trade_date)
SELECT y.instrument_id, y.trade_date, round(close * (f / f_end), 6) AS adj_close, round(preclose * (CASE WHEN f IS NOT NULL THEN coalesce(f_prev, f) / f_end END), 6) AS adj_preclose, f IS NOT NULL AND f_end IS NOT NULL AS is_valid,
       round(ln(close * (f / f_end)) - ln(preclose * (coalesce(f_prev, f) / f_end)), 7) AS log_return FROM y LEFT JOIN e USING (instrument_id)"""
)
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prices.adjust_forward(returns(spark, sf_dir), _factors(spark, sf_dir))
    return out.select("instrument_id", "trade_date", F.round("adj_close", 6).alias("adj_close"), F.round("adj_preclose", 6).alias("adj_preclose"), "is_valid", F.round(prices.log_return(), 7).alias("log_return"))


@query(
    f"""WITH {_FACTORS}, p AS (SELECT *, lag(adjustment_factor) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS f0 FROM fac)
SELECT instrument_id, trade_date, round(adjustment_factor / f0, 9) AS ratio, round(adjustment_factor / f0) AS split_ratio, round(abs(adjustment_factor / f0 / round(adjustment_factor / f0) - 1), 9) AS relative_error
FROM p WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND adjustment_factor / f0 > 1.2
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = p.instrument_id AND l.l_linenumber = 6 AND l.l_quantity = 50 AND CAST(date_trunc('quarter', l.l_shipdate) AS DATE) = p.trade_date)"""
)
def inferred_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cash = load(spark, sf_dir, "lineitem").where("l_linenumber = 6 and l_quantity = 50").select(F.col("l_suppkey").alias("instrument_id"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("ex_date"))
    day = lambda d: F.lit(d).cast("date")
    out = prices.inferred_splits(_factors(spark, sf_dir), day("1996-01-01"), day("2000-12-31"), cash, 1.2)
    return out.select("instrument_id", "trade_date", F.round("ratio", 9).alias("ratio"), "split_ratio", F.round("relative_error", 9).alias("relative_error"))


@query(f"WITH {BARS}, s AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)) SELECT min(trade_date) AS lookback_start FROM s WHERE i >= greatest(1, (SELECT min(i) FROM s WHERE trade_date >= DATE '1997-05-10') - 12)")
def lookback_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = bars(spark, sf_dir).select("trade_date").distinct().withColumn("is_trading_day", F.lit(True))
    return prices.lookback_start(calendar, F.lit("1997-05-10").cast("date"), 12)


@query(
    f"""WITH {RETURNS} SELECT instrument_id, trade_date, max(close) OVER o AS peak, round(sum(log_return) OVER o, 7) AS path, round(CASE WHEN min(CASE WHEN close / preclose - 1 > -1 THEN 1 ELSE 0 END) FILTER (WHERE preclose IS NOT NULL) OVER o = 1 THEN exp(sum(ln(close / preclose)) OVER o) END, 6) AS growth,
coalesce((close > preclose) <> lag(close > preclose) OVER (PARTITION BY instrument_id ORDER BY trade_date), false) AS turned FROM ret WHERE preclose IS NOT NULL WINDOW o AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def running_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maximum, sum and product and a change flag."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = returns(spark, sf_dir).where("preclose is not null")
    return rows.select("instrument_id", "trade_date", win.running_max("close", w).alias("peak"), F.round(win.running_sum("log_return", w), 7).alias("path"), F.round(win.running_growth(F.col("close") / F.col("preclose") - 1, w), 6).alias("growth"), win.changed(F.col("close") > F.col("preclose"), w).alias("turned"))


_CELL = lambda c: f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_HASHES = "CAST(count(*) AS BIGINT) AS n_rows, bit_xor(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS xor_hash, CAST(sum(CAST('0x' || substr(m, 16, 15) AS BIGINT) % 2147483647) AS BIGINT) AS sum_hash"


@query(f"SELECT o_custkey, {_HASHES} FROM (SELECT o_custkey, md5({" || '|' || ".join(_CELL(c) for c in ('o_clerk', 'o_custkey', 'o_orderkey', 'o_orderstatus'))}) AS m FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority AS o_clerk FROM orders)) GROUP BY 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content hash of each customer's orders, some cells null."""
    status = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", status, F.col("o_orderpriority").alias("o_clerk"))
    return relational.content_hash(rows, ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 25")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rows of a table by price (T4)."""
    return relational.tail_rows(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice", "l_orderkey", "l_linenumber"], 25)


_KNOWN = """known AS (SELECT o_custkey AS instrument_id, CAST(o_orderdate AS DATE) AS trade_date, o_orderkey AS row_id, o_totalprice AS x, CAST(o_orderdate AS TIMESTAMP) + INTERVAL (o_orderkey % 90) HOUR AS available_at, o_orderstatus <> 'P' AS pit_usable FROM orders)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, CAST(o_orderkey % 90 AS INT))")
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("x"), at.alias("available_at"), (F.col("o_orderstatus") != "P").alias("pit_usable"))


@query(f"WITH {_KNOWN} SELECT instrument_id, trade_date, row_id, x FROM known WHERE instrument_id IN (2, 5, 40, 41) AND trade_date BETWEEN DATE '1996-02-01' AND DATE '1997-03-31' AND pit_usable AND available_at < TIMESTAMP '1997-04-01'")
def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of listed ids in a range, as known at its end."""
    return reads.bars_of(_known(spark, sf_dir), [2, 5, 40, 41], "1996-02-01", "1997-03-31").select("instrument_id", "trade_date", "row_id", "x")


@query(f"WITH {_KNOWN} SELECT instrument_id, trade_date, row_id, x FROM known WHERE instrument_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND trade_date BETWEEN DATE '1996-02-01' AND DATE '1997-03-31' AND pit_usable AND available_at < TIMESTAMP '1997-04-01'")
def daily_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a table of ids, by a semi-join."""
    ids = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("instrument_id"))
    return reads.bars_of(_known(spark, sf_dir), ids, "1996-02-01", "1997-03-31").select("instrument_id", "trade_date", "row_id", "x")


@query(f"WITH {_KNOWN} SELECT instrument_id, trade_date, row_id, x FROM known WHERE trade_date <= DATE '1996-12-31' AND pit_usable AND available_at < TIMESTAMP '1997-01-01'")
def adjustment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of all ids without a lower bound."""
    return reads.adjustment_factors(_known(spark, sf_dir), "1996-12-31").select("instrument_id", "trade_date", "row_id", "x")


@query(f"WITH {_KNOWN} SELECT 'listed' AS part, count(*) AS n_rows FROM known WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND pit_usable AND available_at < TIMESTAMP '1996-07-01' UNION ALL SELECT 'none', 0")
def event_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range as known at its end (S7), and a read of an empty list of ids, which has no rows."""
    rows = _known(spark, sf_dir)
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n_rows"))
    return n(reads.between(rows, "1996-01-01", "1996-06-30"), "listed").union(n(reads.bars_of(rows, [], "1996-01-01", "1996-06-30"), "none"))
