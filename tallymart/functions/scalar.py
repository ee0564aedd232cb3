"""Column helpers: money, elapsed time, weeks, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money(c: Column | str) -> Column:
    """Exact money. Sums of decimals do not depend on the order in which partitions arrive."""
    return _col(c).cast(MONEY)


def total(c: Column | str) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(_col(c)), F.lit(0)).cast("double")


def mean(c: Column | str) -> Column:
    """Mean of the values that are present, from an exact sum where the input is exact."""
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def flag(c: Column) -> Column:
    """Boolean to 0/1 with missing as 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two timestamps, rounded towards minus infinity."""
    later, earlier = _col(later), _col(earlier)
    days = F.date_diff(later.cast("date"), earlier.cast("date"))
    return F.when(later < earlier + F.make_dt_interval(days), days - 1).otherwise(days).cast("bigint")


def calendar_days(later: Column | str, earlier: Column | str) -> Column:
    """Midnights crossed between two timestamps."""
    return F.date_diff(_col(later).cast("date"), _col(earlier).cast("date")).cast("bigint")


def midnight(day: Column | str) -> Column:
    return _col(day).cast("timestamp_ntz")


def week_start(c: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_col(c).cast("date"), "week")


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "month")


def black_friday(year: str) -> str:
    """SQL text: fourth Friday of November of a year given as SQL text."""
    return f"date_add(next_day(make_date({year}, 10, 31), 'FRI'), 21)"


def easter(year: str) -> str:
    """SQL text: Gregorian Easter Sunday (the Meeus/Jones/Butcher rule)."""
    a, b, c = f"({year} % 19)", f"({year} div 100)", f"({year} % 100)"
    moon = f"((19 * {a} + {b} - {b} div 4 - ({b} - (({b} + 8) div 25) + 1) div 3 + 15) % 30)"
    wday = f"((32 + 2 * ({b} % 4) + 2 * ({c} div 4) - {moon} - {c} % 4) % 7)"
    days = f"({moon} + {wday} - 7 * (({a} + 11 * {moon} + 22 * {wday}) div 451) + 114)"
    return f"make_date({year}, int({days} div 31), int({days} % 31 + 1))"


# month*100+day of the Brazilian national holidays with a fixed date, and the one added in 2024.
FIXED_HOLIDAYS = (101, 421, 501, 907, 1012, 1102, 1115, 1225)
HOLIDAY_SINCE_2024 = 1120


def br_public_holiday(day: str) -> Column:
    """Whether the day in a column is a Brazilian national holiday by public law."""
    md = f"(month({day}) * 100 + dayofmonth({day}))"
    return F.expr(
        f"{md} IN {FIXED_HOLIDAYS} OR {day} = date_sub({easter(f'year({day})')}, 2) "
        f"OR ({md} = {HOLIDAY_SINCE_2024} AND year({day}) >= 2024)"
    )


def log1p_clipped(c: Column | str) -> Column:
    return F.log1p(F.greatest(_col(c).cast("double"), F.lit(0.0)))


def column_name(prefix: str, value: str) -> str:
    """Column name for a category value: lower case, other signs as `_`."""
    return prefix + "".join(ch if ch.isalnum() else "_" for ch in value.lower())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
