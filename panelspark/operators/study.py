"""Factor-study statistics (C10-C22, C24, C26, C27) on factors in long form.

factors: signal_date, instrument_id, factor_id, value, is_valid. returns: signal_date,
instrument_id, future_return. Cross-sections are groups of (signal_date, factor_id), so
one aggregation serves all dates and factors at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import average_rank, bucket, finite, first_reason, guarded_corr, is_finite
from panelspark.operators.relational import small, with_previous_period
from panelspark.operators.windows import island, rolling_mean_of_valid, running_sum

KEYS = ("signal_date", "factor_id")


def usable(factors: DataFrame) -> DataFrame:
    """Valid factor rows of a finite value."""
    return factors.where(F.col("is_valid") & is_finite("value"))


def daily_ic(factors: DataFrame, returns: DataFrame, least: int = 3) -> DataFrame:
    """Pearson and rank IC of each date and factor, or the first reason against one."""
    valid = usable(factors)
    counts = factors.groupBy(*KEYS).agg(F.count_if(F.col("is_valid") & is_finite("value")).alias("factor_count"))
    pairs = valid.select(*KEYS, "instrument_id", F.col("value").alias("x")).join(returns.where(is_finite("future_return")).select("signal_date", "instrument_id", F.col("future_return").alias("y")), ["signal_date", "instrument_id"])
    ranked = pairs.withColumns({"rx": average_rank("x", *KEYS), "ry": average_rank("y", *KEYS)})
    stats = ranked.groupBy(*KEYS).agg(
        F.count("*").alias("pair_count"), guarded_corr("x", "y").alias("ic"), guarded_corr("rx", "ry").alias("rank_ic"),
        (F.max("x") == F.min("x")).alias("__flat_x"), (F.max("y") == F.min("y")).alias("__flat_y"),
    )
    rows = counts.join(stats, list(KEYS), "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))
    reason = first_reason(
        (F.col("factor_count") < least, "INSUFFICIENT_CROSS_SECTION"),
        (F.col("pair_count") < least, "INSUFFICIENT_FORWARD_PAIRS"),
        (F.col("__flat_x"), "ZERO_FACTOR_VARIANCE"),
        (F.col("__flat_y"), "ZERO_RETURN_VARIANCE"),
        (~is_finite("ic") | ~is_finite("rank_ic"), "NONFINITE_IC"),
    )
    rows = rows.withColumn("invalid_reason", reason)
    ok = F.col("invalid_reason").isNull()
    return rows.select(*KEYS, "factor_count", "pair_count", F.when(ok, F.col("ic")).alias("ic"), F.when(ok, F.col("rank_ic")).alias("rank_ic"), ok.alias("is_valid"), "invalid_reason")


def ic_series(ic: DataFrame, column: str = "rank_ic", rows: int = 20, least: int = 10) -> DataFrame:
    """Running sum and rolling mean of an IC along the dates of each factor (C11)."""
    w = Window.partitionBy("factor_id").orderBy("signal_date")
    return ic.withColumns({f"cumulative_{column}": running_sum(column, w), f"rolling_{column}": rolling_mean_of_valid(column, w, rows, least)})


def ic_summary(ic: DataFrame, column: str = "rank_ic") -> DataFrame:
    """Mean, sample std, ICIR, positive rate, five quantiles and the longest streaks of each factor."""
    v = finite(column)
    stats = ic.groupBy("factor_id").agg(
        F.count("*").alias("n_dates"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.try_divide(F.count_if(v > 0).cast("double"), F.count(v).cast("double")).alias("positive_rate"), *[F.percentile(v, p / 100).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)],
    )
    w = Window.partitionBy("factor_id").orderBy("signal_date")
    runs = ic.withColumns({"__up": island(v > 0, w), "__down": island(v < 0, w), "__v": v})
    ups = runs.where("__v > 0").groupBy("factor_id", "__up").count().groupBy("factor_id").agg(F.max("count").alias("up"))
    downs = runs.where("__v < 0").groupBy("factor_id", "__down").count().groupBy("factor_id").agg(F.max("count").alias("down"))
    rows = stats.join(ups, "factor_id", "left").join(downs, "factor_id", "left")
    icir = F.try_divide("mean", "std").alias("icir")
    return rows.select("factor_id", "n_dates", "n_valid", "mean", "std", icir, "positive_rate", "p05", "p25", "p50", "p75", "p95", F.coalesce("up", F.lit(0)).alias("longest_positive"), F.coalesce("down", F.lit(0)).alias("longest_negative"))


def coverage(factors: DataFrame, universe: DataFrame) -> DataFrame:
    """Valid and eligible rows over eligible rows of each date and factor (C13). universe: signal_date, instrument_id, eligible."""
    eligible = universe.where("eligible").select("signal_date", "instrument_id")
    totals = eligible.groupBy("signal_date").agg(F.count("*").alias("eligible_count"))
    hits = factors.where("is_valid").join(eligible, ["signal_date", "instrument_id"], "left_semi").groupBy(*KEYS).agg(F.count("*").alias("valid_count"))
    names = factors.select("factor_id").distinct()
    rows = totals.crossJoin(small(names)).join(hits, list(KEYS), "left").withColumn("valid_count", F.coalesce("valid_count", F.lit(0)))
    return rows.select(*KEYS, "eligible_count", "valid_count", F.try_divide(F.col("valid_count").cast("double"), F.col("eligible_count").cast("double")).alias("coverage"))


def assign_quantiles(factors: DataFrame, q: int = 5) -> DataFrame:
    """Usable rows with their bucket 1..q by (value, instrument_id)."""
    return usable(factors).withColumn("quantile", bucket(q, KEYS, ["value", "instrument_id"]))


def quantile_returns(factors: DataFrame, returns: DataFrame, q: int = 5) -> DataFrame:
    """Count, mean return and factor bounds of every bucket of every date and factor, empty buckets included."""
    rows = assign_quantiles(factors, q).join(returns.select("signal_date", "instrument_id", finite("future_return").alias("future_return")), ["signal_date", "instrument_id"], "left")
    stats = rows.groupBy(*KEYS, "quantile").agg(
        F.count("*").alias("member_count"), F.count("future_return").alias("return_count"), F.avg("future_return").alias("mean_return"), F.min("value").alias("lower_bound"), F.max("value").alias("upper_bound")
    )
    domain = factors.select(*KEYS).distinct().withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(q))))
    out = domain.join(stats, [*KEYS, "quantile"], "left")
    return out.withColumns({"member_count": F.coalesce("member_count", F.lit(0)), "return_count": F.coalesce("return_count", F.lit(0)), "is_empty": F.col("member_count").isNull()})


def long_short(quantiles: DataFrame, q: int = 5) -> DataFrame:
    """Mean return of the top bucket less that of the bottom one; the whole domain must be there and the ends not empty (C17)."""
    at = lambda k, c: F.max(F.when(F.col("quantile") == k, F.col(c)))
    rows = quantiles.groupBy(*KEYS).agg(F.count_distinct("quantile").alias("n_buckets"), at(q, "mean_return").alias("top"), at(1, "mean_return").alias("bottom"), at(q, "return_count").alias("n_top"), at(1, "return_count").alias("n_bottom"))
    reason = first_reason((F.col("n_buckets") < q, "INCOMPLETE_QUANTILE_DOMAIN"), ((F.coalesce("n_top", F.lit(0)) == 0) | (F.coalesce("n_bottom", F.lit(0)) == 0), "MISSING_TERMINAL_QUANTILE_OBSERVATIONS"))
    return rows.select(*KEYS, F.when(reason.isNull(), F.col("top") - F.col("bottom")).alias("spread"), reason.alias("invalid_reason"))


def monotonicity(quantiles: DataFrame, least: int = 3) -> DataFrame:
    """Rank correlation, slope, inversions and terminal spread of the bucket means of each date and factor (C20)."""
    rows = quantiles.where(is_finite("mean_return")).withColumn("q", F.col("quantile").cast("double"))
    w = Window.partitionBy(*KEYS).orderBy("quantile")
    rows = rows.withColumns({"__rank": average_rank("mean_return", *KEYS), "__qrank": average_rank("q", *KEYS), "__down": (F.col("mean_return") < F.lag("mean_return").over(w)).cast("int")})
    stats = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_buckets"), guarded_corr("__qrank", "__rank").alias("rank_correlation"), F.regr_slope("mean_return", "q").alias("slope"),
        F.coalesce(F.sum("__down"), F.lit(0)).alias("inversions"), (F.max_by("mean_return", "quantile") - F.min_by("mean_return", "quantile")).alias("terminal_spread"),
    )
    ok = F.col("n_buckets") >= least
    return stats.select(*KEYS, "n_buckets", *[F.when(ok, F.col(c)).alias(c) for c in ("rank_correlation", "slope", "inversions", "terminal_spread")], F.when(~ok, "INSUFFICIENT_VALID_QUANTILES").alias("invalid_reason"))


def quantile_turnover(factors: DataFrame, q: int = 5) -> DataFrame:
    """Half the sum of weight changes of the top and bottom buckets, held equally weighted, against the previous date, and the rank autocorrelation.

    A leg's turnover is 1 - |both| / max(n, n before), the closed form for equal weights;
    null where either is empty. The previous date is the one before among the factor's dates.
    """
    rows = assign_quantiles(factors, q).select(*KEYS, "instrument_id", "value", "quantile")
    dates = factors.select(*KEYS).distinct().withColumn("previous_date", F.lag("signal_date").over(Window.partitionBy("factor_id").orderBy("signal_date")))
    now = rows.join(dates, list(KEYS))
    then = rows.select(F.col("signal_date").alias("previous_date"), "factor_id", "instrument_id", F.col("value").alias("before"), F.col("quantile").alias("quantile_before"))
    met = now.join(then, ["previous_date", "factor_id", "instrument_id"])
    sizes = rows.groupBy(*KEYS).agg(F.count_if(F.col("quantile") == q).alias("n_top"), F.count_if(F.col("quantile") == 1).alias("n_bottom"))
    sizes_before = sizes.select(F.col("signal_date").alias("previous_date"), "factor_id", F.col("n_top").alias("top_before"), F.col("n_bottom").alias("bottom_before"))
    ranked = met.withColumns({"ra": average_rank("value", *KEYS), "rb": average_rank("before", *KEYS)})
    both = lambda k: F.count_if((F.col("quantile") == k) & (F.col("quantile_before") == k))
    stats = ranked.groupBy(*KEYS).agg(both(q).alias("both_top"), both(1).alias("both_bottom"), guarded_corr("ra", "rb").alias("rank_autocorrelation"))
    out = dates.join(sizes, list(KEYS), "left").join(sizes_before, ["previous_date", "factor_id"], "left").join(stats, list(KEYS), "left")

    def leg(both_: str, n: str, before: str) -> Column:
        return F.when((F.col(n) > 0) & (F.col(before) > 0), F.lit(1.0) - F.coalesce(F.col(both_), F.lit(0)) / F.greatest(n, before))

    out = out.withColumns({"top_turnover": leg("both_top", "n_top", "top_before"), "bottom_turnover": leg("both_bottom", "n_bottom", "bottom_before")})
    total = F.col("top_turnover") + F.col("bottom_turnover")
    reason = first_reason((F.col("previous_date").isNull(), "NO_PREVIOUS_SIGNAL_DATE"), (total.isNull(), "MISSING_TERMINAL_QUANTILE"))
    return out.select(*KEYS, "previous_date", "top_turnover", "bottom_turnover", (F.col("top_turnover") + F.col("bottom_turnover")).alias("turnover"), "rank_autocorrelation", reason.alias("invalid_reason"))


def cost_scenarios(spreads: DataFrame, turnover: DataFrame, bps: Sequence[float] = (0, 5, 10, 20, 50)) -> DataFrame:
    """Mean net spread of each factor at each cost, and the break-even cost in basis points."""
    rows = spreads.where("spread is not null").join(turnover.where("turnover is not null").select(*KEYS, "turnover"), list(KEYS))
    sums = rows.groupBy("factor_id").agg(F.count("*").alias("n_dates"), F.avg("spread").alias("gross"), F.avg("turnover").alias("mean_turnover"), F.sum("spread").alias("s"), F.sum("turnover").alias("t"))
    even = F.when((F.col("s") > 0) & (F.col("t") > 0), F.try_divide(F.col("s") * 10_000, F.col("t")))
    why = first_reason((F.col("s") <= 0, "NONPOSITIVE_GROSS_SPREAD"), (F.col("t") <= 0, "ZERO_TOTAL_TURNOVER"))
    costs = F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("cost_bps")
    out = sums.withColumns({"break_even_bps": even, "break_even_invalid_reason": why}).select("*", costs)
    return out.select("factor_id", "n_dates", "cost_bps", "gross", "mean_turnover", (F.col("gross") - F.col("mean_turnover") * F.col("cost_bps") / 10_000).alias("net"), "break_even_bps", "break_even_invalid_reason")


def factor_correlations(factors: DataFrame, least: int = 3) -> DataFrame:
    """Mean over dates of the daily Pearson and rank correlations of each pair of factors on their common instruments.

    A value travels once, to its date: what is shuffled grows with factors, not with pairs. A date's cross-section is one group,
    instruments by factors; ranks are taken anew for each set of common instruments. A factor that doesn't vary on them has no correlation that day.
    """

    def daily(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="instrument_id", columns="factor_id", values="value", aggfunc="first")
        names, x = list(table.columns), table.to_numpy()
        there, ranks, out = ~np.isnan(x), {}, []

        def ranked(i: int, common: np.ndarray) -> np.ndarray:
            key = (i, common.tobytes())
            if key not in ranks:
                ranks[key] = pd.Series(x[common, i]).rank().to_numpy()
            return ranks[key]

        def corr(a: np.ndarray, b: np.ndarray) -> float:
            a, b = a - a.mean(), b - b.mean()
            return float(a @ b / np.sqrt((a @ a) * (b @ b)))

        for i in range(len(names)):
            for j in range(i, len(names)):
                common = there[:, i] & there[:, j]
                a, b = x[common, i], x[common, j]
                if len(a) >= least and len(a) > 1 and a.max() > a.min() and b.max() > b.min():
                    out.append((names[i], names[j], len(a), corr(a, b), corr(ranked(i, common), ranked(j, common))))
        return pd.DataFrame(out, columns=["factor_x", "factor_y", "n", "pearson", "rank"])

    rows = usable(factors).select("signal_date", "instrument_id", "factor_id", "value")
    each = rows.groupBy("signal_date").applyInPandas(daily, "factor_x string, factor_y string, n long, pearson double, rank double")
    half = each.groupBy("factor_x", "factor_y").agg(F.count("*").alias("n_dates"), F.sum("n").alias("n_pairs"), F.avg("pearson").alias("pearson"), F.avg("rank").alias("rank"))
    mirror = half.where("factor_x < factor_y").select(F.col("factor_y").alias("factor_x"), F.col("factor_x").alias("factor_y"), "n_dates", "n_pairs", "pearson", "rank")
    return half.unionByName(mirror)


def label_quality(labels: DataFrame) -> DataFrame:
    """Rows and share of each reason, of each horizon and kind."""
    keys = ("horizon", "label_kind")
    reason = F.coalesce("invalid_reason", F.lit("VALID")).alias("reason")
    counts = labels.groupBy(*keys, reason).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*keys)))


def industry_coverage(universe: DataFrame, industries: DataFrame) -> DataFrame:
    """Eligible rows of each date by the state of their industry: classified, ended (tombstone) or missing (C26). industries: date, instrument_id, industry, ended."""
    rows = universe.where("eligible").join(industries.withColumnRenamed("date", "signal_date"), ["signal_date", "instrument_id"], "left")
    ended, named = F.coalesce("ended", F.lit(False)), F.coalesce(F.trim("industry") != "", F.lit(False))
    return rows.groupBy("signal_date").agg(
        F.count("*").alias("eligible_count"), F.count_if(named & ~ended).alias("classified"), F.count_if(ended).alias("ended"), F.count_if(~named & ~ended).alias("missing")
    ).withColumn("usable_share", F.try_divide(F.col("classified").cast("double"), F.col("eligible_count").cast("double")))


def signal_variants(factors: DataFrame, directions: DataFrame, neutralized: DataFrame | None = None) -> DataFrame:
    """Factors turned so that more is better, and a neutralized variant beside them (C27). directions: factor_id, direction, a row a factor: it goes to the rows, which keep their places."""
    directions = small(directions)
    turned = lambda df, name: df.join(directions, "factor_id").withColumn("value", F.col("value") * F.col("direction")).drop("direction").withColumn("signal_variant", F.lit(name))
    out = turned(factors, "direction_adjusted")
    return out if neutralized is None else out.unionByName(turned(neutralized, "neutralized"), allowMissingColumns=True)


def previous_values(factors: DataFrame) -> DataFrame:
    """Each factor value beside that of the previous signal date."""
    return with_previous_period(factors, ["factor_id", "instrument_id"], "signal_date", ["value"])
