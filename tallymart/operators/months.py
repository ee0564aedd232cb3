"""Facts stored by month, and date bounds that reach their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.scalar import midnight, month_start

MONTH = "order_month"
BOUGHT = "order_purchase_timestamp"


def with_month(facts: DataFrame) -> DataFrame:
    """The facts with the column that their folders are named after, ready to be written by it."""
    # rebalancing splits a month with many rows and merges small ones, so files keep an even size
    return facts.withColumn(MONTH, month_start(BOUGHT)).hint("rebalance", MONTH)


def bought_between(facts: DataFrame, first: Column | None, end: Column | None) -> DataFrame:
    """Rows bought from midnight of the day `first` on and before midnight of the day `end`.

    None is no bound; a bound drops rows without a time. Where the facts are stored by month, the months that the
    bounds imply are named too, so that only their folders are read, also where a day is a scalar subquery.
    """
    bought = F.col(BOUGHT)
    stored = MONTH in facts.columns
    if first is not None:
        facts = facts.where(bought >= midnight(first))
        facts = facts.where(F.col(MONTH) >= F.trunc(first, "month")) if stored else facts
    if end is not None:
        facts = facts.where(bought < midnight(end))
        facts = facts.where(F.col(MONTH) <= F.trunc(F.date_sub(end, 1), "month")) if stored else facts
    return facts
