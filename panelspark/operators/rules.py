"""Market rules as data (R1-R5): trading profiles, dated price limits and fees, joined to rows by broadcast intervals.

Prices are counted in whole ticks and money in whole cents; every rounding is half up
on integers or decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the exchanges' rules: profiles, dated limits and fees.
PROFILES = [
    # profile, price_tick, buy_minimum, buy_increment, sell_minimum, sell_increment, settlement_sessions, limit_group, fee_group
    ("STOCK_MAIN", "0.01", 100, 100, 100, 100, 1, "MAIN", "STOCK"),
    ("STOCK_CHINEXT", "0.01", 100, 100, 100, 100, 1, "CHINEXT", "STOCK"),
    ("STOCK_STAR", "0.01", 200, 1, 200, 1, 1, "STAR", "STOCK"),
    ("STOCK_BSE", "0.01", 100, 1, 100, 1, 1, "BSE", "STOCK"),
    ("ETF_STOCK_T1_10", "0.001", 100, 100, 100, 100, 1, "ETF_10", "ETF"),
    ("ETF_STOCK_T1_20", "0.001", 100, 100, 100, 100, 1, "ETF_20", "ETF"),
    ("ETF_CROSS_BORDER_T0_10", "0.001", 100, 100, 100, 100, 0, "ETF_10", "ETF"),
]
ETF_PROFILES = {"510050.SH": "ETF_STOCK_T1_10", "510300.SH": "ETF_STOCK_T1_10", "588000.SH": "ETF_STOCK_T1_20", "513100.SH": "ETF_CROSS_BORDER_T0_10"}
PRICE_LIMITS = [
    ("MAIN", "NORMAL", "2005-01-24", None, "0.10"),
    ("MAIN", "ST", "2005-01-24", "2026-07-05", "0.05"),
    ("MAIN", "ST", "2026-07-06", None, "0.10"),
    ("CHINEXT", "NORMAL", "2005-01-24", "2020-08-23", "0.10"),
    ("CHINEXT", "NORMAL", "2020-08-24", None, "0.20"),
    ("CHINEXT", "ST", "2005-01-24", "2020-08-23", "0.05"),
    ("CHINEXT", "ST", "2020-08-24", None, "0.20"),
    ("STAR", "NORMAL", "2005-01-24", None, "0.20"),
    ("STAR", "ST", "2005-01-24", None, "0.20"),
    ("BSE", "NORMAL", "2005-01-24", None, "0.30"),
    ("BSE", "ST", "2005-01-24", None, "0.30"),
    ("ETF_10", "NORMAL", "2005-01-24", None, "0.10"),
    ("ETF_20", "NORMAL", "2005-01-24", None, "0.20"),
]
STAMP_DUTY = [
    ("BUY", "2005-01-24", "2007-05-29", "0.001"),
    ("BUY", "2007-05-30", "2008-04-23", "0.003"),
    ("BUY", "2008-04-24", "2008-09-18", "0.001"),
    ("BUY", "2008-09-19", None, "0"),
    ("SELL", "2005-01-24", "2007-05-29", "0.001"),
    ("SELL", "2007-05-30", "2008-04-23", "0.003"),
    ("SELL", "2008-04-24", "2023-08-27", "0.001"),
    ("SELL", "2023-08-28", None, "0.0005"),
]
TRANSFER_FEE = [
    ("SSE", "2005-01-24", "2012-05-31", "face_value", "0.0005"),
    ("SSE", "2012-06-01", "2012-08-31", "face_value", "0.000375"),
    ("SSE", "2012-09-01", "2015-07-31", "face_value", "0.0003"),
    ("SSE", "2015-08-01", "2022-04-28", "turnover", "0.00002"),
    ("SSE", "2022-04-29", None, "turnover", "0.00001"),
    ("SZSE", "2005-01-24", "2015-07-31", "turnover", "0.0000255"),
    ("SZSE", "2015-08-01", "2022-04-28", "turnover", "0.00002"),
    ("SZSE", "2022-04-29", None, "turnover", "0.00001"),
    ("BSE", "2005-01-24", "2022-04-28", "turnover", "0.00002"),
    ("BSE", "2022-04-29", None, "turnover", "0.00001"),
]
COMMISSION_RATE, COMMISSION_MINIMUM = "0.0003", 500
RULES_START = "2005-01-24"


def _intervals(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of dated rules with DATE start and end and a decimal rate: a dozen rows."""
    df = spark.createDataFrame(rows, columns)
    changes = {"rule_start": F.col("rule_start").cast("date"), "rule_end": F.coalesce(F.col("rule_end").cast("date"), F.lit("9999-12-31").cast("date")), "rate": F.col("rate").cast("decimal(12,8)")}
    return df.withColumns(changes)


def price_limit_table(spark: SparkSession) -> DataFrame:
    return _intervals(spark, PRICE_LIMITS, "limit_group string, status string, rule_start string, rule_end string, rate string")


def stamp_table(spark: SparkSession) -> DataFrame:
    return _intervals(spark, STAMP_DUTY, "side string, rule_start string, rule_end string, rate string")


def transfer_table(spark: SparkSession) -> DataFrame:
    return _intervals(spark, TRANSFER_FEE, "exchange string, rule_start string, rule_end string, basis string, rate string")


def broken_intervals(table: DataFrame, keys: list[str], first_day: Column | None = None) -> DataFrame:
    """Keys whose intervals don't start on the first day (that of the rules, if none is given), leave a gap, overlap or don't end open."""
    first_day = F.lit(RULES_START).cast("date") if first_day is None else first_day
    w = Window.partitionBy(*keys).orderBy("rule_start")
    rows = table.withColumns({"next": F.lead("rule_start").over(w), "first": F.row_number().over(w) == 1})
    gap = F.when(F.col("next").isNotNull(), F.date_add("rule_end", 1) != F.col("next")).otherwise(F.col("rule_end") != F.lit("9999-12-31").cast("date"))
    return rows.where(gap | (F.col("first") & (F.col("rule_start") != first_day))).select(*keys, "rule_start")


def with_profile(instruments: DataFrame) -> DataFrame:
    """instruments (instrument_id, instrument_type, board) with their trading profile: an ETF's own, else by type and board."""
    spark = instruments.sparkSession
    names = ["profile", "price_tick", "buy_minimum", "buy_increment", "sell_minimum", "sell_increment", "settlement_sessions", "limit_group", "fee_group"]
    profiles = spark.createDataFrame(PROFILES, names).withColumn("price_tick", F.col("price_tick").cast("decimal(6,3)"))
    own = F.create_map(*[F.lit(x) for pair in ETF_PROFILES.items() for x in pair])
    profile = F.coalesce(F.try_element_at(own, F.col("instrument_id")), F.when(F.col("instrument_type") == "STOCK", F.concat(F.lit("STOCK_"), F.col("board"))))
    return instruments.withColumn("profile", profile).join(F.broadcast(profiles), "profile", "left")


def dated(rows: DataFrame, table: DataFrame, keys: list[str], day: str = "trade_date") -> DataFrame:
    """rows with the rule in force on their day (left join on keys and interval)."""
    on = F.col(day).between(F.col("rule_start"), F.col("rule_end"))
    t = F.broadcast(table.select(*[F.col(k).alias(f"__{k}") for k in keys], "rule_start", "rule_end", *[c for c in table.columns if c not in (*keys, "rule_start", "rule_end")]))
    for k in keys:
        on = on & (rows[k] == F.col(f"__{k}"))
    return rows.join(t, on, "left").drop("rule_start", "rule_end", *[f"__{k}" for k in keys])


def price_limits(rows: DataFrame) -> DataFrame:
    """rows (limit_group, status, trade_date, preclose_ticks) with upper and lower limit in ticks, halves up (R2); null without a rule."""
    out = dated(rows, price_limit_table(rows.sparkSession), ["limit_group", "status"])
    at = lambda sign: F.round(F.col("preclose_ticks").cast("decimal(18,0)") * (F.lit(1).cast("decimal(2,0)") + F.col("rate") * sign), 0).cast("long")
    return out.withColumns({"upper_ticks": at(1), "lower_ticks": at(-1)}).drop("rate")


def fees(fills: DataFrame) -> DataFrame:
    """fills (fee_group, exchange, side, trade_date, gross_cents, quantity) with commission, stamp duty and transfer fee in cents, halves up (R3). ETFs pay commission alone; a face value is one yuan a share."""
    spark = fills.sparkSession
    rows = dated(fills, stamp_table(spark).withColumnRenamed("rate", "stamp_rate"), ["side"])
    rows = dated(rows, transfer_table(spark).withColumnRenamed("rate", "transfer_rate"), ["exchange"])
    part = lambda base, rate: F.round(base.cast("decimal(18,0)") * rate, 0).cast("long")
    gross, stock = F.col("gross_cents"), F.col("fee_group") == "STOCK"
    base = F.when(F.col("basis") == "face_value", F.col("quantity") * 100).otherwise(gross)
    none = F.lit(0).cast("long")
    commission = F.when(gross > 0, F.greatest(part(gross, F.lit(COMMISSION_RATE).cast("decimal(12,8)")), F.lit(COMMISSION_MINIMUM).cast("long"))).otherwise(none)
    rows = rows.withColumns({"commission": commission, "stamp_duty": F.when(stock, F.coalesce(part(gross, F.col("stamp_rate")), none)).otherwise(none), "transfer_fee": F.when(stock, F.coalesce(part(base, F.col("transfer_rate")), none)).otherwise(none)})
    return rows.withColumn("total_fees", F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee")).drop("stamp_rate", "transfer_rate", "basis")


def allowed_quantity(side: Column, quantity: Column, held: Column) -> Column:
    """Whether an order's size fits the profile: minimum and increment, or a sale of the whole odd lot."""
    grid = lambda low, step: (quantity >= F.col(low)) & ((quantity - F.col(low)) % F.col(step) == 0)
    odd = (quantity == held) & (held > 0)
    return F.when(side == "BUY", grid("buy_minimum", "buy_increment")).otherwise(grid("sell_minimum", "sell_increment") | odd)


def profile_floor(side: Column, quantity: Column) -> Column:
    """The largest size up to quantity that fits the profile's minimum and increment, 0 if none does."""
    fit = lambda low, step: F.when(quantity >= F.col(low), quantity - (quantity - F.col(low)) % F.col(step)).otherwise(F.lit(0).cast("long"))
    return F.when(side == "BUY", fit("buy_minimum", "buy_increment")).otherwise(fit("sell_minimum", "sell_increment"))
