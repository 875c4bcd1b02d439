"""Instants and local days (§2.13): timestamps hold UTC without a zone, so that results don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import col


def local_time(instant: Column | str, zone: str) -> Column:
    """What the clocks of a zone show at a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(instant).cast("timestamp_ntz"))


def local_day(instant: Column | str, zone: str) -> Column:
    """The day in a zone on which a UTC instant falls."""
    return local_time(instant, zone).cast("date")


def at_time(day: Column | str, time: str, zone: str) -> Column:
    """The UTC instant at which the clocks of a zone show HH:MM:SS on a day."""
    hours, minutes, seconds = (int(x) for x in time.split(":"))
    wall = col(day).cast("date").cast("timestamp_ntz") + F.expr(f"INTERVAL '{hours}:{minutes}:{seconds}' HOUR TO SECOND")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def day_end(day: Column | str, zone: str) -> Column:
    """The last microsecond of a day in a zone, as a UTC instant: what became known by then was known on that day."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(col(day).cast("date"), 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND"))


def trading_day(instant: Column | str, close: str, zone: str) -> Column:
    """The local day whose close comes next: from the close on, an instant belongs to the day after."""
    day = local_day(instant, zone)
    return F.when(col(instant).cast("timestamp_ntz") < at_time(day, close, zone), day).otherwise(F.date_add(day, 1))
