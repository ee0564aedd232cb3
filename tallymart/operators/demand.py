"""Weekly demand panel and its supervised features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymart.config import TOTAL, UNKNOWN
from tallymart.functions.scalar import week_start
from tallymart.operators.calendar import calendar_features
from tallymart.session import stage_table

LAGS = (1, 2, 3, 4, 8, 12)
MEANS = (4, 8)
CALENDAR = ("weekofyear", "month", "n_holidays", "black_friday", "post_black_friday", "christmas")
FEATURES = (
    *[f"lag_{k}" for k in LAGS], *[f"roll_mean_{k}" for k in MEANS], "roll_std_4", *CALENDAR, "series_code",
)


def category_weeks(items: DataFrame) -> DataFrame:
    """Units per (category, week) with the last order day: the only pass over the items."""
    bought = F.col("order_purchase_timestamp")
    return items.where(bought.isNotNull()).groupBy("category", week_start(bought).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.max(bought.cast("date")).alias("last_day")
    )


def top_categories(counts: DataFrame, n: int) -> DataFrame:
    """The n categories with most units; `unknown` is not one of them. Ties go to the first name."""
    sized = counts.where(F.col("category") != UNKNOWN).groupBy("category").agg(F.sum("n").alias("units"))
    return sized.orderBy(F.desc("units"), "category").limit(n)


def weekly_demand(items: DataFrame, top_n: int = 15) -> DataFrame:
    """Units per series and week, zero-filled: the top categories and `__total__` over all categories.

    Weeks run from the first to the last order; the last is dropped when its Sunday lies after the last
    order. The items are reduced to one row per (category, week) and written once; the rest works on that.
    """
    counts = stage_table(category_weeks(items), "category_weeks")
    top = top_categories(counts, top_n).select("category")
    span = counts.agg(
        F.min("week").alias("lo"), F.max("week").alias("hi"), F.max("last_day").alias("last_day")
    ).where("lo IS NOT NULL")
    full = F.when(F.col("last_day") < F.date_add("hi", 6), F.date_sub("hi", 7)).otherwise(F.col("hi"))
    weeks = span.withColumn("hi", full).where("hi >= lo").agg(
        F.max(F.expr("sequence(lo, hi, interval 7 days)"))
    ).scalar()

    per_series = counts.join(top, "category", "left_semi").select(F.col("category").alias("series"), "week", "n")
    totals = counts.groupBy("week").agg(F.sum("n").alias("n")).select(F.lit(TOTAL).alias("series"), "week", "n")
    known = per_series.unionByName(totals)
    names = top.select(F.col("category").alias("series")).unionByName(
        counts.agg(F.lit(TOTAL).alias("series"))
    )
    grid = names.select("series", F.explode(weeks).alias("week"))
    return (
        grid.join(known, ["series", "week"], "left")
        .select("series", "week", F.coalesce("n", F.lit(0)).cast("double").alias("y"))
        .orderBy("series", "week")
    )


def wide(panel: DataFrame, series: list[str]) -> DataFrame:
    """One row per week and one column per listed series."""
    return panel.groupBy("week").pivot("series", series).agg(F.first("y")).orderBy("week")


def long(weeks: DataFrame, series: list[str]) -> DataFrame:
    """Inverse of `wide`."""
    return weeks.unpivot("week", series, "series", "y").select("series", "week", "y")


def supervised(panel: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Lags and rolling statistics of log(1 + y) over earlier weeks, and the calendar features.

    Values without a full history are null. The windows are per series and hold one row per week.
    """
    by = Window.partitionBy("series").orderBy("week")

    def earlier(fn, width: int):
        frame = by.rowsBetween(-width, -1)
        return F.when(F.count("ly").over(frame) == width, fn("ly").over(frame))

    df = panel.withColumn("ly", F.log1p("y"))
    df = df.select(
        "*",
        *[F.lag("ly", k).over(by).alias(f"lag_{k}") for k in LAGS],
        *[earlier(F.avg, k).alias(f"roll_mean_{k}") for k in MEANS],
        earlier(F.stddev_samp, 4).alias("roll_std_4"),
    )
    calendar = calendar_features(panel.select("week").distinct(), holidays)
    # one row per week; the code is the position of the series in name order
    codes = panel.select("series").distinct().agg(F.sort_array(F.collect_list("series"))).scalar()
    return df.join(calendar, "week", "left").withColumn("_codes", codes).withColumn(
        "series_code", F.array_position("_codes", F.col("series")) - 1
    ).drop("_codes")
