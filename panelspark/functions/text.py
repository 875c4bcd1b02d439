"""Cleaning of delivered strings (§2.13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.numeric import col

#: Spellings of a missing value and of true (fixed values).
MISSING = ("", "None", "nan", "NaN")
TRUE = ("1", "Y", "true", "True")
#: Form of an instrument's id (fixed value).
CODE = r"^[0-9]{6}\.(?:SH|SZ|BJ)$"


def cleaned(c: Column | str) -> Column:
    """Without white space around it; null where nothing or a spelling of "missing" is left."""
    text = F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")
    return F.when(~text.isin(*MISSING), text)


def to_day(c: Column | str) -> Column:
    """A date written as 20240131 or 2024-01-31; null where it is none."""
    digits = F.replace(cleaned(c), F.lit("-"), F.lit(""))
    return F.when(digits.rlike("^[0-9]{8}$"), F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def to_flag(c: Column | str) -> Column:
    """Whether a string is a spelling of true; null where it is missing."""
    return cleaned(c).isin(*TRUE)


def to_number(c: Column | str, factor: float = 1.0) -> Column:
    """A number in other units; null where it is none."""
    return cleaned(c).try_cast("double") * F.lit(float(factor))


def is_code(c: Column | str) -> Column:
    """Whether a string is an instrument's id; null counts as none."""
    return F.coalesce(col(c).rlike(CODE), F.lit(False))


def year_of(c: Column | str) -> Column:
    """The first four characters where they are digits, as a year."""
    year = F.substring(cleaned(c), 1, 4)
    return F.when(year.rlike("^[0-9]{4}$"), year.cast("int"))
