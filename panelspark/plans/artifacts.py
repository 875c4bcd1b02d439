"""Runs published and read back (S13, S14) over the sample tables: rows, keys and the sum of one figure of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import performance as perf
from panelspark.operators import relational
from panelspark.plans import decisions, market, more, study  # noqa: F401  their queries fill the tables
from panelspark.plans.decisions import _NAV, _nav
from panelspark.plans.tables import QUERIES, SQL, bars, kept, load, query, shared_folder
from panelspark.sources import artifacts

#: Of each table of a study the query that fills it and the figure that is summed.
_STUDY = {
    "summary": ("ic_summary", "mean"), "coverage": ("coverage", "coverage"), "label_quality": ("label_quality", "share"), "industry_coverage": ("industry_coverage", "usable_share"), "ic": ("daily_ic", "rank_ic"),
    "quantile_returns": ("quantile_returns", "mean_return"), "long_short_returns": ("long_short", "spread"), "monotonicity": ("monotonicity", "slope"), "turnover": ("quantile_turnover", "turnover"),
    "cost_scenarios": ("cost_scenarios", "net"), "correlations": ("factor_correlations", "rank"),
}
_STRATEGY = {
    "signals": ("dual_ma", "instrument_id"), "orders": ("rebalance_plan", "order_quantity"), "fills": (None, "gross_value"), "holdings": (None, "market_value"), "costs": (None, "fees"), "nav": (None, "equity"), "dividends": ("entitlements", "new_shares"),
    "performance": ("daily_returns", "daily_return"), "rolling_performance": ("rolling_block", "max_drawdown"), "drawdown_episodes": ("drawdown_episodes", "n_sessions"), "monthly_returns": ("monthly_returns", "period_return"), "annual_returns": (None, "period_return"),
    "execution_summary": ("execution_summary", "requested"), "exposure_summary": ("exposures", "weight"), "attribution": ("attribution_rollup", "contribution"),
}
_OWN = {
    "fills": "SELECT s_nationkey AS portfolio_id, CAST(l_shipdate AS DATE) AS trade_date, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS result_index, CAST(l_quantity AS BIGINT) * 100 AS gross_value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "holdings": f"WITH {_NAV} SELECT portfolio_id, trade_date, i AS security, equity // (10 + i) AS market_value FROM nav, unnest(range(0, 4)) AS u(i)",
    "costs": "SELECT CAST(l_shipdate AS DATE) AS trade_date, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS result_index, CAST(l_quantity AS BIGINT) AS fees FROM lineitem",
    "nav": f"WITH {_NAV} SELECT * FROM nav",
    "annual_returns": f"WITH {_NAV}, e AS (SELECT portfolio_id, date_trunc('year', trade_date) AS period, arg_max(equity, trade_date) AS l, arg_min(equity, trade_date) AS f FROM nav GROUP BY 1, 2) SELECT portfolio_id, period, round(l::DOUBLE / coalesce(lag(l) OVER (PARTITION BY portfolio_id ORDER BY period), f) - 1, 9) AS period_return FROM e",
}


def _sql(fills: dict[str, tuple[str | None, str]], contracts: dict[str, artifacts.Contract]) -> str:
    parts = []
    for name, (source, figure) in fills.items():
        keys = ", ".join(contracts[name].keys)
        parts.append(f"SELECT '{name}' AS artifact, count(*) AS n_rows, count(DISTINCT ({keys})) AS n_keys, round(CAST(coalesce(sum({figure}), 0) AS DOUBLE), 4) AS total FROM ({SQL[source] if source else _OWN[name]})")
    return " UNION ALL ".join(parts)


def _read_back(spark: SparkSession, run: str, fills: dict[str, tuple[str | None, str]], contracts: dict[str, artifacts.Contract]) -> DataFrame:
    out = None
    for name, (_, figure) in fills.items():
        rows = artifacts.read_table(spark, run, name, contracts)
        n_keys = artifacts.distinct_keys(artifacts.read_table_files(spark, run, name, contracts), contracts[name].keys)
        one = rows.agg(F.lit(name).alias("artifact"), F.count("*").alias("n_rows"), F.lit(n_keys).alias("n_keys"), F.round(F.coalesce(F.sum(figure), F.lit(0)).cast("double"), 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query(_sql(_STUDY, artifacts.STUDY))
def study_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven tables of a factor study, published as one run."""
    run = artifacts.publish_run(spark, study.study_tables(spark, sf_dir), artifacts.STUDY, shared_folder(spark, "studies"), "study")
    return _read_back(spark, run, _STUDY, artifacts.STUDY)


@query(_sql(_STRATEGY, artifacts.STRATEGY))
def strategy_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen tables of strategy runs, published as one run (S14). Net asset values, bars and numbered lines are worked out once and kept."""
    nav = kept(_nav(spark, sf_dir), "nav")
    b = kept(bars(spark, sf_dir).select("instrument_id", "trade_date", "close", "amount", "volume"), "bars")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("portfolio_id"))
    q, day = F.col("l_quantity").cast("long"), F.col("day").alias("trade_date")
    lines = relational.row_index(load(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date")), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["day"], "result_index")
    lines = kept(lines.select("l_suppkey", "day", "result_index", "l_quantity", "l_extendedprice"), "lines")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("reference_price")
    fills = lines.join(s, "l_suppkey").select("portfolio_id", day, "result_index", q.alias("requested_quantity"), q.alias("filled_quantity"), price, (q * 100).alias("gross_value"))
    own = {
        "fills": fills, "costs": lines.select(day, "result_index", q.alias("fees")), "nav": nav, "annual_returns": perf.period_returns(nav, "year").withColumn("period_return", F.round("period_return", 9)),
        "holdings": nav.select("portfolio_id", "trade_date", "equity", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("security")).select("portfolio_id", "trade_date", "security", F.floor(F.col("equity") / (F.col("security") + 10)).cast("long").alias("market_value")),
    }
    own |= decisions.strategy_tables(b, nav)
    tables = {name: own[name] if name in own else QUERIES[source](spark, sf_dir) for name, (source, _) in _STRATEGY.items()}
    run = artifacts.publish_run(spark, tables, artifacts.STRATEGY, shared_folder(spark, "runs"), "strategy")
    return _read_back(spark, run, _STRATEGY, artifacts.STRATEGY)
