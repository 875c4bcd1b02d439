"""Joins, top-k, latest rows and contract checks over any DataFrame."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only where its count is at most this.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have `rows` rows at most: for pairs of dimension tables, whose join has no key. Joins on keys are left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chain_keys(parts: Sequence[Column]) -> Column:
    """All of several conditions."""
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, worked out and kept in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, as in tests, in a local one, on a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or f"file://{tempfile.gettempdir()}/panelspark-checkpoints")
    return df.checkpoint()


def require_columns(df: DataFrame, **types: str) -> DataFrame:
    """df, or an error that names each missing or mistyped column."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')}, not {t}" for c, t in types.items() if c not in have or t not in ("", have[c])]
    if wrong:
        raise ValueError("columns do not meet the contract: " + "; ".join(wrong))
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"more than one row has the same {', '.join(keys)}")
    return df


def left_join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "m:1") -> DataFrame:
    """Left join after a check that keys are unique on the right, and on both sides for 1:1."""
    require_unique(right, keys)
    if validate == "1:1":
        require_unique(left, keys)
    return left.join(right, list(keys), "left")


def row_index(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Zero-based index by a total order within keys (P10). Without keys the whole frame is one window: for small frames only."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def first_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "is_first") -> DataFrame:
    """Marks the first row of each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order, every tie decided by order itself."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def visible_at(df: DataFrame, cutoff: Column, usable: str | None = "pit_usable") -> DataFrame:
    """Rows that were usable and available at cutoff."""
    seen = F.col("available_at").isNotNull() & (F.col("available_at") <= cutoff)
    return df.where(seen & F.col(usable) if usable else seen)


def latest_visible(df: DataFrame, keys: Sequence[str], cutoff: Column, usable: str | None = "pit_usable") -> DataFrame:
    """Of each business key the last visible revision, by (available_at, revision)."""
    return latest(visible_at(df, cutoff, usable), keys, ["available_at", "revision"])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """left with `values` and `<on>_matched` of the last right row at or before left's `on` (before it, if strict).

    Both sides go through one shuffle and one sort: a union in which right rows come
    before left rows of the same time (after them, if strict), then the last right
    payload seen. A matched row whose value is null still counts as a match. right must
    be unique on by + on. Left rows of a null key or time match nothing.
    """
    payload = F.struct(F.col(on).alias("matched"), *[F.col(v) for v in values])
    l_order, r_order = (0, 1) if strict else (1, 0)
    a = left.select(F.struct(*left.columns).alias("__left"), *[F.col(k).alias(f"__{k}") for k in by], F.col(on).alias("__on"), F.lit(l_order).alias("__side"))
    b = right.where(F.col(on).isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in by], F.col(on).alias("__on"), F.lit(r_order).alias("__side"), payload.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*[f"__{k}" for k in by]).orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, 0)
    known = chain_keys([F.col(f"__{k}").isNotNull() for k in by])
    met = both.withColumn("__m", F.last("__right", ignorenulls=True).over(w)).where("__left is not null")
    found = F.when(known & F.col("__on").isNotNull(), F.col("__m"))
    return met.select("__left.*", found["matched"].alias(f"{on}_matched"), *[found[v].alias(v) for v in values])


def interval_state(memberships: DataFrame, dates: DataFrame, key: str, in_date: str, out_date: str, cutoff: str, in_known: str, out_known: str, order: Sequence[Column]) -> DataFrame:
    """For each date and key the membership valid then, on two clocks.

    A membership counts if it began by the date and that was known by the date's
    cutoff, and if its end is open, later, or not known yet. Among several the last
    by `order` counts. dates: distinct `date`, cutoff. Memberships meet the dates of each month
    from their beginning to the last day on which their end may not be known by an equi-join on
    the month, of which the rest is filtered; cutoffs lag behind their dates by `lag` days at most. Memberships of a key with the
    same four times are valid together, so only the last of them by `order` meets the dates.
    """
    times = [F.col(c) for c in (in_date, out_date, in_known, out_known)]
    first = F.row_number().over(Window.partitionBy(key, *times).orderBy(*order))
    memberships = memberships.withColumn("__n", first).where("__n = 1").drop("__n")
    ended = F.col(out_date).isNotNull() & (F.col(out_date) <= F.col("date")) & F.col(out_known).isNotNull() & (F.col(out_known) <= F.col(cutoff))
    valid = (F.col(in_date) <= F.col("date")) & (F.col(in_known) <= F.col(cutoff)) & ~ended
    months = F.sequence(F.trunc(F.col(in_date), "month"), F.trunc("__last", "month"), F.expr("INTERVAL 1 MONTH"))
    last, lag = dates.agg(F.max("date"), F.max(F.date_diff("date", F.col(cutoff).cast("date")))).first()  # two values
    closed = F.greatest(F.col(out_date).cast("date"), F.date_add(F.col(out_known).cast("date"), lag or 0))
    until = F.least(F.lit(last).cast("date"), F.when(F.col(out_date).isNotNull() & F.col(out_known).isNotNull(), closed))  # least passes over nulls
    begun = memberships.withColumn("__last", until).where(F.col(in_date) <= F.col("__last")).withColumn("__month", F.explode(months)).drop("__last")
    met = begun.join(dates.withColumn("__month", F.trunc("date", "month")), "__month").where(valid).drop("__month")
    n = F.row_number().over(Window.partitionBy("date", key).orderBy(*order))
    return met.withColumn("__n", n).where("__n = 1").drop("__n")


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two small dimension tables, such as instruments and sessions (J5): the smaller side is broadcast after a check."""
    return left.crossJoin(small(right))


def with_previous_period(df: DataFrame, key: Sequence[str], period: str, values: Sequence[str]) -> DataFrame:
    """df with `previous_<period>` (the period before among those present) and the key's values then."""
    dates = df.select(period).distinct()
    dates = dates.withColumn(f"previous_{period}", F.lag(period).over(Window.orderBy(period)))  # one row per period
    then = df.select(*key, F.col(period).alias(f"previous_{period}"), *[F.col(v).alias(f"previous_{v}") for v in values])
    return df.join(dates, period).join(then, [*key, f"previous_{period}"], "left")


def sorted_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The distinct values of each key in order, as a list."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


def top_n(df: DataFrame, keys: Sequence[str], n: int, score: str, tie: str) -> DataFrame:
    """The n best rows of each key by (-score, tie), with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_and_other(df: DataFrame, keys: Sequence[str], name: str, value: str, n: int = 20) -> DataFrame:
    """The n names of largest |value| by key (ties to the smaller name), the rest summed as OTHER."""
    sums = df.groupBy(*keys, name).agg(F.sum(value).alias(value))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(value).desc(), name))
    shown = F.when(rank <= n, F.col(name).cast("string")).otherwise("OTHER")
    return sums.withColumn("bucket", shown).groupBy(*keys, "bucket").agg(F.sum(value).alias(value), F.count("*").alias("n_names"))


def tail_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of the whole frame by order (T4): a top-k, not a sort of everything."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows by a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def last_sessions(calendar: DataFrame, until: Column, n: int = 21) -> DataFrame:
    """The last n sessions at or before a date."""
    return calendar.where(F.col("trade_date") <= until).orderBy(F.col("trade_date").desc()).limit(n)


def content_hash(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n_rows and an order-free hash of the rows by key (A16): exclusive-or and sum (modulo 2**31 - 1 a row) of numbers from each row's MD5, so repeated rows count.

    A row is its columns by name, each with its length, or as null: no two rows read alike.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    cell = lambda c: F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-"))
    digest = F.md5(F.concat_ws("|", *[cell(c) for c in sorted(df.columns)]).cast("binary"))
    number = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    rows = df.withColumns({"__a": number(1), "__b": F.pmod(number(16), F.lit((1 << 31) - 1))})
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.bit_xor("__a").alias("xor_hash"), F.sum("__b").alias("sum_hash"))
