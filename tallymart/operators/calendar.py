"""Day and week calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.scalar import black_friday, br_public_holiday


def with_holiday_flag(days: DataFrame, day: str, holidays: DataFrame | None = None) -> DataFrame:
    """Add `is_holiday`. `holidays` is an optional frame with one `date` column; default: public law of Brazil."""
    if holidays is None:
        return days.withColumn("is_holiday", br_public_holiday(day))
    listed = holidays.select(F.col("date").cast("date").alias(day), F.lit(True).alias("is_holiday")).distinct()
    return days.join(listed, day, "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def dim_date(facts: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """One row per day from the first to the last order."""
    span = facts.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    # one row in, one row per day out
    days = span.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    days = days.selectExpr(
        "date", "bigint(year(date)) AS year", "bigint(month(date)) AS month", "trunc(date, 'week') AS week_start",
        "bigint(weekday(date)) AS dayofweek", "weekday(date) >= 5 AS is_weekend",
        f"date = {black_friday('year(date)')} AS is_black_friday",
    )
    flagged = with_holiday_flag(days, "date", holidays)
    return flagged.select(
        "date", "year", "month", "week_start", "dayofweek", "is_weekend", "is_holiday", "is_black_friday"
    )


def calendar_features(weeks: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Per Monday in `weeks`: ISO week, month, holidays in the week, and the sales-event flags."""
    days = weeks.select("week", F.explode(F.sequence("week", F.date_add("week", 6))).alias("day"))
    counted = (
        with_holiday_flag(days, "day", holidays)
        .groupBy("week")
        .agg(F.sum(F.col("is_holiday").cast("int")).alias("n_holidays"))
    )

    def holds_friday(first: str, last: str) -> str:
        # an interval of a week can reach into the next year
        hits = [f"{black_friday(f'year({edge})')} BETWEEN {first} AND {last}" for edge in (first, last)]
        return f"bigint({hits[0]} OR {hits[1]})"

    return counted.selectExpr(
        "week", "bigint(weekofyear(week)) AS weekofyear", "bigint(month(week)) AS month",
        "bigint(n_holidays) AS n_holidays",
        f"{holds_friday('week', 'date_add(week, 6)')} AS black_friday",
        f"{holds_friday('date_sub(week, 7)', 'date_sub(week, 1)')} AS post_black_friday",
        "bigint(month(week) = 12 AND dayofmonth(week) BETWEEN 8 AND 24) AS christmas",
    )
