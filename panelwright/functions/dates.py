"""Business-day arithmetic and calendar encodings as plain expressions.

A Mon-Fri calendar without holidays has a closed form, so shifting a date needs no calendar table and no
join.  Day 0 is Monday 1970-01-05; a weekend date carries the index of the Friday before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

MONDAY = "1970-01-05"


def bday_index(d) -> Column:
    days = F.datediff(col(d), F.to_date(F.lit(MONDAY)))
    return (F.floor(days / F.lit(7.0)) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))).cast("int")


def from_bday_index(i) -> Column:
    i = col(i)
    days = (F.floor(i / F.lit(5.0)) * 7 + F.pmod(i, F.lit(5))).cast("int")
    return F.date_add(F.to_date(F.lit(MONDAY)), days)


def add_bdays(d, n) -> Column:
    """The date ``n`` business days after ``d``."""
    n = F.lit(n) if isinstance(n, int) else col(n)
    return from_bday_index(bday_index(d) + n)


def is_bday(d) -> Column:
    return F.weekday(col(d)) < 5


def cyclic(d) -> dict[str, Column]:
    """Month and ISO-week position on a circle."""
    d = col(d)
    turn = 2 * math.pi
    month, week = F.month(d) / F.lit(12.0), F.weekofyear(d) / F.lit(52.0)
    return {
        "month_sin": F.sin(month * turn),
        "month_cos": F.cos(month * turn),
        "week_sin": F.sin(week * turn),
        "week_cos": F.cos(week * turn),
    }


# Months and first day of the two season flags.
SEASON = {"in_season": ((1, 4, 7, 10), 10), "pre_season": ((12, 3, 6, 9), 20)}


def season_flags(d) -> dict[str, Column]:
    """1.0 from a given day on in the listed months, else 0.0."""
    d = col(d)
    return {
        name: (F.month(d).isin(list(months)) & (F.dayofmonth(d) >= first_day)).cast("double")
        for name, (months, first_day) in SEASON.items()
    }
