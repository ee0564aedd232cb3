"""Customer value expected over the next twelve months."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.functions.scalar import midnight
from tallymart.operators.months import bought_between
from tallymart.operators.ranking import with_rank_bin

# Tiers from the lowest value, and the rank shares that separate them.
TIERS = ("low", "mid", "high", "top 5%")
TIER_CUTS = (Fraction(1, 2), Fraction(4, 5), Fraction(19, 20))


def orders_per_repeater(facts: DataFrame, cutoff: Column, config: Config) -> DataFrame:
    """Mean orders in the window after the cutoff, over customers who had also ordered before; 1 if none.

    Both conditions are counted in one aggregation per customer instead of a semi-join.
    """
    bought = F.col("order_purchase_timestamp")
    known = facts.where(F.col("customer_unique_id").isNotNull())
    known = bought_between(known, None, F.date_add(cutoff, config.window_days)).withColumn("_cut", cutoff)
    cut = F.col("_cut")
    inside = (bought >= midnight(cut)) & (bought < midnight(F.date_add(cut, config.window_days)))
    per = known.groupBy("customer_unique_id").agg(
        F.count_if(inside).alias("n"), F.count_if(bought < midnight(cut)).alias("before")
    )
    repeated = per.where((F.col("n") > 0) & (F.col("before") > 0))
    return repeated.agg(F.coalesce(F.avg("n"), F.lit(1.0)).alias("orders_per_window"))


def clv(scored: DataFrame, orders_per_window: Column, config: Config) -> DataFrame:
    """Expected orders, expected value and tier. A customer without a known order value is worth 0."""
    expected = F.col("p_repeat") * orders_per_window * config.clv_days / config.window_days
    value = F.coalesce("avg_order_value", F.lit(0.0)) * F.col("expected_orders_12m") * F.lit(config.margin)
    valued = scored.withColumn("expected_orders_12m", expected).withColumn("clv_12m", value)
    binned = with_rank_bin(valued, F.col("clv_12m"), "customer_unique_id", TIER_CUTS, "_bin")
    names = F.array(*[F.lit(t) for t in TIERS])
    return binned.withColumn("clv_tier", F.element_at(names, F.col("_bin").cast("int"))).drop("_bin")
