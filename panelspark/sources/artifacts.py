"""Runs of a study or a strategy as sets of related tables.

A run's tables are written below one staging folder, each checked against its contract before
(columns and types) and after (rows written and read, keys without nulls or repeats, rows of a file in
key order). Only a set without violations is moved to its place, by one rename of the folder, so a run is
there whole or not at all, and a failed one leaves whatever was there before. On stores where a
rename is a copy, the move takes as long as a copy and isn't atomic: put runs on a file system there.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.relational import require_columns


class Contract(NamedTuple):
    """keys tell rows apart and order them; columns: names and types."""

    keys: tuple[str, ...]
    columns: str

    def types(self) -> dict[str, str]:
        return dict(c.split(" ") for c in self.columns.split(", "))


# fixed values: the tables of a factor study, with what tells their rows apart
STUDY = {
    "summary": Contract(("factor_id",), "factor_id string, n_dates bigint, n_valid bigint, mean double, std double, icir double, positive_rate double, longest_positive bigint, longest_negative bigint"),
    "coverage": Contract(("factor_id", "signal_date"), "signal_date date, factor_id string, eligible_count bigint, valid_count bigint, coverage double"),
    "label_quality": Contract(("label_kind", "horizon", "reason"), "label_kind string, horizon int, reason string, n_rows bigint, share double"),
    "industry_coverage": Contract(("signal_date",), "signal_date date, eligible_count bigint, classified bigint, ended bigint, missing bigint, usable_share double"),
    "ic": Contract(("factor_id", "signal_date"), "signal_date date, factor_id string, factor_count bigint, pair_count bigint, ic double, rank_ic double, is_valid boolean, invalid_reason string"),
    "quantile_returns": Contract(("factor_id", "signal_date", "quantile"), "signal_date date, factor_id string, quantile int, member_count bigint, return_count bigint, mean_return double, lower_bound double, upper_bound double, is_empty boolean"),
    "long_short_returns": Contract(("factor_id", "signal_date"), "signal_date date, factor_id string, spread double, invalid_reason string"),
    "monotonicity": Contract(("factor_id", "signal_date"), "signal_date date, factor_id string, n_buckets bigint, rank_correlation double, slope double, inversions bigint, terminal_spread double, invalid_reason string"),
    "turnover": Contract(("factor_id", "signal_date"), "signal_date date, factor_id string, previous_date date, top_turnover double, bottom_turnover double, turnover double, rank_autocorrelation double, invalid_reason string"),
    "cost_scenarios": Contract(("factor_id", "cost_bps"), "factor_id string, n_dates bigint, cost_bps double, gross double, mean_turnover double, net double, break_even_bps double, break_even_invalid_reason string"),
    "correlations": Contract(("factor_x", "factor_y"), "factor_x string, factor_y string, n_dates bigint, n_pairs bigint, pearson double, rank double"),
}

# fixed values: the tables of strategy runs; a run may hold many portfolios
STRATEGY = {
    "signals": Contract(("signal_date", "instrument_id"), "signal_date date, instrument_id bigint, direction string, changed boolean, invalid_reason string"),
    "orders": Contract(("signal_date", "sequence"), "signal_date date, sequence int, instrument_id bigint, side string, order_quantity bigint"),
    "fills": Contract(("trade_date", "result_index"), "portfolio_id int, trade_date date, result_index bigint, requested_quantity bigint, filled_quantity bigint, reference_price double, gross_value bigint"),
    "holdings": Contract(("portfolio_id", "trade_date", "security"), "portfolio_id int, trade_date date, security int, market_value bigint"),
    "costs": Contract(("trade_date", "result_index"), "trade_date date, result_index bigint, fees bigint"),
    "nav": Contract(("portfolio_id", "trade_date"), "portfolio_id int, trade_date date, equity bigint, benchmark bigint"),
    "dividends": Contract(("run_id", "instrument_id", "record_date"), "run_id int, instrument_id bigint, record_date date, quantity bigint, cash_cents bigint, new_shares bigint"),
    "performance": Contract(("portfolio_id", "trade_date"), "portfolio_id int, trade_date date, daily_return double, benchmark_return double, active_return double, drawdown double"),
    "rolling_performance": Contract(("portfolio_id", "trade_date"), "portfolio_id int, trade_date date, annualized_return double, annualized_volatility double, sharpe_ratio double, max_drawdown double, tracking_error double, information_ratio double, beta double"),
    "drawdown_episodes": Contract(("portfolio_id", "episode"), "portfolio_id int, episode bigint, peak_date date, trough_date date, depth double, recovery_date date, n_sessions bigint"),
    "monthly_returns": Contract(("portfolio_id", "period"), "portfolio_id int, period date, period_return double"),
    "annual_returns": Contract(("portfolio_id", "period"), "portfolio_id int, period date, period_return double"),
    "execution_summary": Contract(("portfolio_id", "side", "reason_code"), "portfolio_id string, side string, reason_code string, n_orders bigint, requested bigint, filled bigint, unfilled bigint, requested_notional bigint, filled_notional bigint, n_unpriced bigint"),
    "exposure_summary": Contract(("portfolio_id", "trade_date", "bucket"), "portfolio_id int, trade_date date, bucket string, market_value bigint, weight double"),
    "attribution": Contract(("portfolio_id", "security"), "portfolio_id int, security bigint, contribution bigint"),
}


def files(spark: SparkSession, path: str):
    """The path and its file system, whichever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = files(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = files(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """One rename; an error if the target is there or the store refuses."""
    (a, fs), (b, _) = files(spark, source), files(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def conformed(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in its order; an error that names what is missing or of another type."""
    types = contract.types()
    return require_columns(df, **types).select(*types)


def written_rows(df: DataFrame, path: str, keys: tuple[str, ...]) -> int:
    """Writes df in key order and says how many rows went out."""
    seen = Observation()
    # behind the shuffle: what finds the ranges reads df once more
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    return seen.get["n"]


def _stretches(keys: tuple[str, ...]):
    """Per batch the stretches of rows that follow each other in a file: ends, counts, first and last key. A batch begins with the last row of the one before, so that every two neighbours of a task meet."""

    def above(t: pa.Table, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row of a sorts above that of b (nulls lowest), and whether their keys are equal."""
        higher, same = np.zeros(b.stop - b.start, bool), np.ones(b.stop - b.start, bool)
        for k in keys:
            x, y = (t.column(k).combine_chunks()[s] for s in (a, b))
            no_x, no_y = x.is_null().to_numpy(zero_copy_only=False), y.is_null().to_numpy(zero_copy_only=False)
            more, equal = (f(x, y).fill_null(False).to_numpy(zero_copy_only=False) for f in (pc.greater, pc.equal))
            higher |= same & (more | (~no_x & no_y))
            same &= equal | (no_x & no_y)
        return higher, same

    def run(batches):
        before = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            n, old = t.num_rows, int(before is not None)
            file, at = t.column("__file").to_numpy(), t.column("__at").to_numpy()
            next_to = (file[1:] == file[:-1]) & (at[1:] == at[:-1] + 1)
            higher, same = above(t, slice(0, n - 1), slice(1, n))
            null = np.zeros(n, bool)
            for k in keys:
                null |= t.column(k).combine_chunks().is_null().to_numpy(zero_copy_only=False)
            new, null[:old] = np.arange(n) >= old, False
            first = np.r_[0, np.flatnonzero(~next_to) + 1]
            last = np.r_[first[1:] - 1, n - 1]
            total = lambda x: np.add.reduceat(x.astype(np.int64), first)  # noqa: B023, E731
            counts = [file[first], at[first], at[last], total(new), total(null), total(np.r_[False, higher & next_to]), total(np.r_[False, same & next_to])]
            ends = [t.column(k).combine_chunks().take(pa.array(i)) for i in (first, last) for k in keys]
            yield pa.RecordBatch.from_arrays([*map(pa.array, counts), *ends], names=["file", "start", "end", "n", "nulls", "lower", "same", *[f"first_{k}" for k in keys], *[f"last_{k}" for k in keys]])
            before = batch.slice(batch.num_rows - 1)

    return run


def key_order(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for the files of a table: n rows, null_keys, unordered (rows whose predecessor in the file sorts above them) and unproven, which is 0 only if all keys differ.

    A task compares neighbours as it reads them; only ends of stretches of some thousand rows are dealt, to meet the next stretch of the file and the next file.
    """
    placed = rows.select(*keys, F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    types = dict(placed.dtypes)
    ends = ", ".join(f"`{end}_{k}` {types[k]}" for end in ("first", "last") for k in keys)
    found = placed.mapInArrow(_stretches(keys), f"file long, start long, end long, n long, nulls long, lower long, same long, {ends}")
    first, last = (F.struct(*[F.col(f"{end}_{k}").alias(k) for k in keys]) for end in ("first", "last"))
    found = found.select("file", "start", "end", "n", "nulls", "lower", "same", first.alias("first"), last.alias("last"))
    w = Window.partitionBy("file").orderBy("start", "end")
    apart = F.lag("end").over(w) < F.col("start")  # else they have a row in common
    met = found.withColumns({"__lower": apart & (F.lag("last").over(w) > F.col("first")), "__same": apart & (F.lag("last").over(w) == F.col("first"))})
    files = met.groupBy("file").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), (F.sum("lower") + F.count_if("__lower")).alias("unordered"), (F.sum("same") + F.count_if("__same")).alias("same"),
        F.min_by("first", "start").alias("first"), F.max_by("last", "end").alias("last"),
    )
    ranges = files.withColumn("__over", F.coalesce(F.lag("last").over(Window.orderBy("first", "last")) >= F.col("first"), F.lit(False)))  # a row a file
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return ranges.agg(total("n").alias("n"), total("nulls").alias("null_keys"), total("unordered").alias("unordered"), (total("unordered") + total("same") + total("nulls") + F.count_if("__over")).alias("unproven"))


def distinct_keys(rows: DataFrame, keys: tuple[str, ...]) -> int:
    """How many keys a table's files hold: their rows where files are in strict order, else counted."""
    found = key_order(rows, keys).first()
    return rows.agg(F.count_distinct(F.struct(*keys))).first()[0] if found.unproven else found.n


def violations(rows: DataFrame, name: str, contract: Contract, expected: int) -> DataFrame:
    """One row for a written table: how many rows lack, have a null key, share a key, or stand before a row of their file that sorts lower.

    Where files and their ranges are in strict key order no key is there twice; only else are the keys dealt anew and counted.
    """
    found = key_order(rows, contract.keys).first()  # four numbers
    repeated = rows.groupBy(*contract.keys).count().where("count > 1").agg(F.count("*").alias("repeated_keys")) if found.unproven else rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("repeated_keys"))
    return repeated.select(F.lit(name).alias("artifact"), F.lit(expected - found.n).alias("missing_rows"), F.lit(found.null_keys).alias("null_keys"), "repeated_keys", F.lit(found.unordered).alias("unordered"))


def read_table(spark: SparkSession, run: str, name: str, contracts: Mapping[str, Contract]) -> DataFrame:
    """A table of a run by its contract; an error if its files have other columns or types."""
    return conformed(spark.read.parquet(f"{run}/{name}"), contracts[name])


def publish_run(spark: SparkSession, tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract], root: str, run: str, replace: bool = False) -> str:
    """Writes all tables of a run and returns its folder. An existing run is an error unless it is to be replaced; then it is moved aside until the new one is in place."""
    if set(tables) != set(contracts):
        raise ValueError(f"tables do not meet the contract: {sorted(set(tables) ^ set(contracts))}")
    target, mark = f"{root.rstrip('/')}/{run}", uuid.uuid4().hex
    staging, aside = f"{root.rstrip('/')}/.staging-{run}-{mark}", f"{root.rstrip('/')}/.replaced-{run}-{mark}"
    if exists(spark, target) and not replace:
        raise FileExistsError(target)
    try:
        ready = {name: conformed(tables[name], contract) for name, contract in contracts.items()}
        counts = {name: written_rows(df, f"{staging}/{name}", contracts[name].keys) for name, df in ready.items()}
        checks = [violations(read_table_files(spark, staging, name, contracts), name, contracts[name], counts[name]) for name in contracts]
        found = checks[0]
        for c in checks[1:]:
            found = found.unionByName(c)
        bad = found.where("missing_rows <> 0 or null_keys > 0 or repeated_keys > 0 or unordered > 0").collect()  # a row a table at most
        if bad:
            raise ValueError("tables do not meet the contract: " + "; ".join(str(r.asDict()) for r in bad))
        if exists(spark, target):
            move(spark, target, aside)
            try:
                move(spark, staging, target)
            except BaseException:
                move(spark, aside, target)
                raise
            remove(spark, aside)
        else:
            move(spark, staging, target)
    except BaseException:
        remove(spark, staging)
        raise
    return target


def read_table_files(spark: SparkSession, run: str, name: str, contracts: Mapping[str, Contract]) -> DataFrame:
    """The files of a table as they are, after a check of their columns."""
    rows = spark.read.parquet(f"{run}/{name}")
    conformed(rows, contracts[name])
    return rows
