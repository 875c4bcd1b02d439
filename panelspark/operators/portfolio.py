"""Constructors of target weights under limits (B2, B5, B7): Spark ranks, folds and sums over dates; one date's few names are solved together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import is_finite
from panelspark.operators.decisions import industry_cap

#: Weights and turnovers that differ by less are taken as equal.
CLOSE = 1e-12


def best_weights(score: np.ndarray, covariance: np.ndarray, held: np.ndarray, most: np.ndarray, risk: float, cost: float) -> np.ndarray:
    """The weights from 0 to `most` and of sum 1 at most where score - risk * variance - cost * |change| is largest.

    A price on the sum is found by halving: the sum of the best weights falls as it
    rises. At a given price the weights are settled one at a time: each has a
    closed form given the others, a parabola with a kink at what is held.
    """

    def at_price(price: float, w: np.ndarray) -> np.ndarray:
        for _ in range(500):
            before = w.copy()
            for i in range(len(w)):
                slope = score[i] - price - 2 * risk * (covariance[i] @ w - covariance[i, i] * w[i])
                bend = 2 * risk * covariance[i, i]
                if bend > 0:
                    up, down = (slope - cost) / bend, (slope + cost) / bend
                    w[i] = up if up > held[i] else down if down < held[i] else held[i]
                else:
                    w[i] = most[i] if slope > cost else 0.0 if slope < -cost else held[i]
                w[i] = min(max(w[i], 0.0), most[i])
            if np.abs(w - before).max(initial=0.0) < CLOSE:
                break
        return w

    w = at_price(0.0, np.minimum(np.maximum(held, 0.0), most))
    if w.sum() <= 1:
        return w
    low, high = 0.0, float(np.abs(score).max() + cost + 2 * risk * np.abs(covariance).sum())
    for _ in range(60):
        price = (low + high) / 2
        w = at_price(price, w)
        low, high = (price, high) if w.sum() > 1 else (low, price)
    w = at_price(high, w)
    return w / max(1.0, w.sum())


def alpha_risk_cost(candidates: DataFrame, covariance: DataFrame, most: int, max_weight: float, risk: float = 1.0, cost: float = 0.001, most_turnover: float = 1.0) -> DataFrame:
    """Weights of the `most` best candidates of each date by centred score, risk and cost of change (B2).

    candidates: signal_date, instrument_id, score, current_weight, capacity_limit; covariance:
    instrument_x <= instrument_y, covariance. A group is one date's `most` rows, each with
    its row of the matrix. Where the one-way turnover is above its limit, all go only so
    far of the way from what is held as it allows.
    """
    best = Window.partitionBy("signal_date").orderBy(F.col("score").desc(), "instrument_id")
    top = candidates.where(is_finite("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    both = covariance.union(covariance.where("instrument_x < instrument_y").select(F.col("instrument_y"), F.col("instrument_x"), "covariance"))
    members = top.select("signal_date", F.col("instrument_id").alias("instrument_y"), F.col("rank").alias("other"))
    rows = top.join(members, "signal_date").join(both.withColumnRenamed("instrument_x", "instrument_id"), ["instrument_id", "instrument_y"], "left")
    packed = rows.groupBy("signal_date", "instrument_id", "rank", "score", "current_weight", "capacity_limit").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", F.coalesce("covariance", F.lit(0.0)).alias("c")))), lambda x: x["c"]).alias("covariances"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        score, held = rows["score"].to_numpy(float), rows["held"].to_numpy(float)
        w = best_weights(score - score.mean(), np.stack(rows["covariances"].to_list()), held, rows["cap"].to_numpy(float), risk, cost)
        return pd.DataFrame({"signal_date": rows["signal_date"], "instrument_id": rows["instrument_id"], "held": held, "wanted": w})

    kind = dict(candidates.dtypes)["instrument_id"]
    ready = packed.withColumns({"held": F.greatest(F.coalesce("current_weight", F.lit(0.0)), F.lit(0.0)), "cap": F.greatest(F.least(F.coalesce("capacity_limit", F.lit(float(max_weight))), F.lit(float(max_weight))), F.lit(0.0))})
    solved = ready.groupBy("signal_date").applyInPandas(solve, f"signal_date date, instrument_id {kind}, held double, wanted double")
    turnover = F.sum(F.abs(F.col("wanted") - F.col("held"))).over(Window.partitionBy("signal_date")) / 2
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(most_turnover)), turnover), F.lit(1.0)))
    return solved.select("signal_date", "instrument_id", (F.col("held") + share * (F.col("wanted") - F.col("held"))).alias("target_weight"))


def turnover_limited(rows: DataFrame, most_positions: int, max_weight: float, limit: float) -> DataFrame:
    """What of each date's target a limit on one-way turnover allows (B7). rows: signal_date, instrument_id, current_weight, target_weight, target_rank.

    Positions above max_weight come down to it first. Names that the target adds are
    taken in the order of target_rank (then id): into a free place, or else in place of the
    smallest position that the target drops; one that the limit doesn't allow is passed
    over. Then what is held moves towards its target weight as far as the limit
    allows, all by one share; dropped names that nothing replaced stay as they are. It is an
    error if a date holds more than most_positions, or if coming down to max_weight
    alone breaks the limit. A date's lists are its held and its wanted names.
    """
    weight = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    each = rows.select("signal_date", "instrument_id", "target_rank", weight("current_weight").alias("now"), weight("target_weight").alias("goal"))
    each = each.withColumns({"held": F.col("now") > CLOSE, "wanted": F.col("goal") > CLOSE}).where("held or wanted")
    each = each.withColumn("kept", F.least("now", F.lit(float(max_weight))))

    adds = F.when(F.col("wanted") & ~F.col("held"), F.struct("target_rank", "instrument_id", "goal"))
    drops = F.when(F.col("held") & ~F.col("wanted"), F.struct("now", "instrument_id", "kept"))
    days = each.groupBy("signal_date").agg(
        F.count_if("held").cast("int").alias("n"), F.coalesce(F.sum(F.when(F.col("held"), F.col("now") - F.col("kept"))), F.lit(0.0)).alias("cut"),
        F.array_sort(F.collect_list(adds)).alias("adds"), F.array_sort(F.collect_list(drops)).alias("drops"),
    )
    allowed = F.lit(float(limit) + CLOSE)
    stop = lambda text: F.raise_error(F.lit(text))
    used = F.when(F.col("n") > most_positions, stop("more positions are held than may be").cast("double")).when(F.col("cut") / 2 > allowed, stop("the limit on a weight breaks the limit on turnover").cast("double")).otherwise(F.col("cut") / 2)

    def take(state: Column, add: Column) -> Column:
        full = state["n"] >= most_positions
        out = F.get(state["drops"], state["out"])
        spent = state["used"] + add["goal"] / 2 + F.when(full, out["kept"] / 2).otherwise(0.0)
        fits = F.coalesce((~full | out["instrument_id"].isNotNull()) & (spent <= allowed), F.lit(False))
        return F.struct(
            F.when(fits, spent).otherwise(state["used"]).alias("used"), F.when(fits & ~full, state["n"] + 1).otherwise(state["n"]).alias("n"), F.when(fits & full, state["out"] + 1).otherwise(state["out"]).alias("out"),
            F.when(fits, F.array_append(state["taken"], add["instrument_id"])).otherwise(state["taken"]).alias("taken"), state["drops"].alias("drops"),
        )

    kind = dict(rows.dtypes)["instrument_id"]
    start = F.struct(used.alias("used"), F.col("n").alias("n"), F.lit(0).alias("out"), F.array().cast(f"array<{kind}>").alias("taken"), F.col("drops").alias("drops"))
    swaps = days.select("signal_date", F.aggregate("adds", start, take).alias("s")).select("signal_date", "s.used", "s.taken", F.transform(F.slice("s.drops", F.lit(1), F.col("s.out")), lambda d: d["instrument_id"]).alias("gone"))
    left = each.join(swaps, "signal_date").where((F.col("held") & ~F.array_contains("gone", F.col("instrument_id"))) | F.array_contains("taken", F.col("instrument_id")))
    left = left.withColumn("base", F.when(F.col("held"), F.col("kept")).otherwise(F.col("goal"))).withColumn("aim", F.when(F.col("wanted"), F.col("goal")).otherwise(F.col("base")))
    way = F.sum(F.abs(F.col("aim") - F.col("base"))).over(Window.partitionBy("signal_date")) / 2
    share = F.when(F.col("used") + way <= allowed, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.lit(float(limit)) - F.col("used"), way)))
    return left.select("signal_date", "instrument_id", (F.col("base") + share * (F.col("aim") - F.col("base"))).alias("target_weight"))


def assembled(scores: DataFrame, most: int, max_weight: float, industry_limit: float, limit: float) -> DataFrame:
    """Top names, industry cap and turnover limit in a row (B5). scores: signal_date, instrument_id, score, industry, current_weight."""
    best = Window.partitionBy("signal_date").orderBy(is_finite("score").desc(), F.col("score").desc(), "instrument_id")
    rows = scores.withColumn("target_rank", F.row_number().over(best))
    chosen = is_finite("score") & (F.col("target_rank") <= most)
    many = F.count_if(chosen).over(Window.partitionBy("signal_date"))
    rows = rows.withColumn("weight", F.when(chosen, F.least(F.lit(1.0) / many, F.lit(float(max_weight)))).otherwise(0.0))
    return turnover_limited(industry_cap(rows, industry_limit), most, max_weight, limit)
