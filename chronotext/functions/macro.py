"""Scalar functions of the macro panel: calendar arithmetic, quarters, futures-implied rates, spreads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_key(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarter_end(key: Column) -> Column:
    """'1968Q4' to the last day of the quarter; null if it is no quarter."""
    y, q = F.regexp_extract(key, r"^(\d{4})Q([1-4])$", 1).try_cast("int"), F.regexp_extract(key, r"^(\d{4})Q([1-4])$", 2).try_cast("int")
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def months_apart(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def implied_rate(meeting: Column, price: Column, next_price: Column, rate_before: Column, late_days: int = 7) -> Column:
    """Expected rate after a meeting from the month's average rate (100 - price); with few days left, the next month's."""
    length, before = F.day(F.last_day(meeting)), F.day(meeting)
    after = length - before
    return F.when(after <= late_days, 100 - next_price).otherwise((length * (100 - price) - before * rate_before) / after)


def contract_price(today: Column, meeting: Column, prices: Column) -> Column:
    """The price of the contract of the meeting's month, from an array of prices by months ahead (0: this month); null beyond it."""
    ahead = months_apart(today, meeting)
    return F.when(ahead >= 0, F.get(prices, ahead))


def simple_implied_rate(first: Column, second: Column, price: bool = True) -> Column:
    """The front contract, else the second; as a rate (100 - price), or as it is."""
    return (100 - F.coalesce(first, second)) if price else F.coalesce(first, second)


def gap(value: Column, target: Column | float, strict_compat: bool = False) -> Column:
    """value - target; strict_compat counts a missing value as 0, as some published panels do."""
    t = target if isinstance(target, Column) else F.lit(target)
    return (F.coalesce(value, F.lit(0.0)) if strict_compat else value) - t


def observation(text: Column) -> Column:
    """A number, null for '.' and anything else that is none."""
    return F.nullif(F.trim(text), F.lit(".")).try_cast("double")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def number_range(text: Column) -> Column:
    """The midpoint of '1.5-2.0' or the number itself, as text of a table."""
    a = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    b = F.regexp_extract(text, r"\d\s*(?:to|[-–])\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(b.isNotNull(), (a + b) / 2).otherwise(a)
