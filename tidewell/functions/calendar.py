"""Week calendar: weeks end on Saturday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mmwr_to_date(year: Column, week: Column) -> Column:
    """The Saturday that ends an epidemiological week: week 1 is the first with four days or more in its year."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(1), F.lit(3)), "SAT"), (7 * (week - 1)).cast("int"))


def week_ending(day: Column) -> Column:
    """The Saturday on or after a day."""
    return F.next_day(F.date_sub(day, 1), "SAT")


def last_saturday(day: Column) -> Column:
    """The Saturday on or before a day."""
    return F.date_sub(F.next_day(day, "SAT"), 7)


def shift_weeks(day: Column, weeks: int | Column) -> Column:
    return F.date_add(day, (weeks * 7).cast("int") if isinstance(weeks, Column) else 7 * weeks)


def iso_week(day: Column, clip: int = 52) -> Column:
    """ISO week number; week 53 counts as `clip`."""
    return F.least(F.weekofyear(day), F.lit(clip))


def year_phase(day: Column, times: int, wave: str) -> Column:
    """sin or cos of the day of the year, `times` turns a year."""
    angle = F.dayofyear(day) / F.lit(365.25) * F.lit(2.0) * F.pi() * F.lit(float(times))
    return F.sin(angle) if wave == "sin" else F.cos(angle)


def in_season(day: Column) -> Column:
    """1 from October to March."""
    return ((F.month(day) >= 10) | (F.month(day) <= 3)).cast("int")


def in_peak(day: Column) -> Column:
    """1 from December to February."""
    return F.month(day).isin(12, 1, 2).cast("int")
