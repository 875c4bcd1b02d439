"""Lots under stock dividends and splits (L2), set-wise.

What an action adds depends on what the actions before it added, so each holding's actions are
folded in order, in one aggregate over the few actions of an instrument. What was bought by a record date is a running
sum found before that. Costs need no fold: every action leaves the total cost as it is and deals it anew by
quantities, so only the last action that a lot lived through counts.

Shares of a dividend are floored on the holding at the record close (buys of the record date and shares that
went ex by then included); a split at its ex date multiplies what is held before that day's buys. New shares form a lot of no cost, bought at the ex date, sellable from
their listing date, and the holding's whole cost is dealt by quantity: floored to cents, the last lot by (buy date, sellable
date, order) taking the rest, so the sum stays.

Defined results: actions on what isn't held add nothing; lots bought on or after the last ex date keep their cost; null quantities count as 0;
no lots or no actions leave the other side as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("run_id", "instrument_id")
_ADDED = "array<struct<event_id:bigint,ex_date:date,listing_date:date,added:bigint>>"


def added_shares(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """run_id, instrument_id, event_id, ex_date, listing_date, added: what each action brings each holding.

    lots: run_id, instrument_id, buy_date, quantity. actions: instrument_id, event_id, action_type
    (DIVIDEND or FUND_SPLIT), record_date, ex_date, listing_date, stock_per_share (a split's: shares after for one before).
    """
    runs = lots.select(*KEYS).distinct()
    is_split = F.col("action_type") == "FUND_SPLIT"
    # a split counts what was bought before its ex date, a dividend what was bought by its record date
    until = F.when(is_split, F.date_sub("ex_date", 1)).otherwise(F.col("record_date"))
    events = actions.join(runs, "instrument_id").withColumn("until", until).withColumn("split", is_split)
    moves = lots.select(*KEYS, F.col("buy_date").alias("day"), F.coalesce("quantity", F.lit(0)).cast("long").alias("q"), F.lit(0).alias("side"))
    payload = F.struct("until", "event_id", "ex_date", "record_date", "listing_date", "split", F.col("stock_per_share").cast("decimal(18,8)").alias("per"))
    both = moves.unionByName(events.select(*KEYS, F.col("until").alias("day"), F.lit(1).alias("side"), payload.alias("event")), allowMissingColumns=True)
    so_far = Window.partitionBy(*KEYS).orderBy("day", "side")  # peers included: all buys of a day
    met = both.withColumn("bought", F.coalesce(F.sum("q").over(so_far), F.lit(0))).where("side = 1")
    folded = met.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("event.until", "event.event_id", "event.ex_date", "event.record_date", "event.listing_date", "event.split", "event.per", "bought"))).alias("events"))

    def step(out: Column, e: Column) -> Column:
        before = F.filter(out, lambda x: F.when(e["split"], x["ex_date"] <= e["ex_date"]).otherwise(x["ex_date"] <= e["record_date"]))
        held = e["bought"] + F.aggregate(before, F.lit(0).cast("long"), lambda s, x: s + x["added"])
        gets = F.floor(held.cast("decimal(18,0)") * e["per"]).cast("long") - F.when(e["split"], held).otherwise(F.lit(0).cast("long"))
        return F.concat(out, F.array(F.struct(e["event_id"].cast("long").alias("event_id"), e["ex_date"].alias("ex_date"), e["listing_date"].alias("listing_date"), F.when(held > 0, gets).otherwise(F.lit(0).cast("long")).alias("added"))))

    each = folded.select(*KEYS, F.explode(F.aggregate("events", F.array().cast(_ADDED), step)).alias("a"))
    return each.select(*KEYS, "a.event_id", "a.ex_date", "a.listing_date", "a.added").where("added <> 0")


def dealt_cost(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The group's whole cost by quantity, floored, the last row by order taking what is left."""
    whole = Window.partitionBy(*group)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    total, shares = F.sum("cost_cents").over(whole), F.sum("quantity").over(whole)
    part = F.call_function("div", total.cast("decimal(19,0)") * wide("quantity"), shares.cast("decimal(19,0)"))
    last = F.lead(F.lit(1)).over(whole.orderBy(*order)).isNull()
    others = F.sum(part).over(whole) - part
    return F.when(last, total - others).otherwise(part).cast("long")


def after_actions(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """All lots after all actions: run_id, instrument_id, kind (BUY or STOCK), lot, buy_date, sellable_date, quantity, cost_cents. lots: the same without kind."""
    new = added_shares(lots, actions)
    last = new.groupBy(*KEYS).agg(F.max("ex_date").alias("last_ex"))
    bought = lots.select(*KEYS, F.lit("BUY").alias("kind"), F.col("lot").cast("long").alias("lot"), "buy_date", "sellable_date", F.coalesce("quantity", F.lit(0)).cast("long").alias("quantity"), F.coalesce("cost_cents", F.lit(0)).cast("long").alias("cost_cents"))
    given = new.select(*KEYS, F.lit("STOCK").alias("kind"), F.col("event_id").alias("lot"), F.col("ex_date").alias("buy_date"), F.coalesce("listing_date", F.lit("9999-12-31").cast("date")).alias("sellable_date"), F.col("added").alias("quantity"), F.lit(0).cast("long").alias("cost_cents"))
    rows = bought.unionByName(given).join(last, list(KEYS), "left")
    # lots that the last action dealt costs to: new ones, and what was bought before its ex date
    lived = F.coalesce((F.col("kind") == "STOCK") | (F.col("buy_date") < F.col("last_ex")), F.lit(False))
    rows = rows.withColumn("lived", lived)
    dealt = dealt_cost(rows, (*KEYS, "lived"), ("buy_date", "sellable_date", "kind", "lot"))
    rows = rows.withColumn("dealt", dealt)
    return rows.select(*KEYS, "kind", "lot", "buy_date", "sellable_date", "quantity", F.when(F.col("lived"), F.col("dealt")).otherwise(F.col("cost_cents")).alias("cost_cents"))
