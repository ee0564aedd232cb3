"""Recency, frequency and monetary scores and the segments built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymart.functions.scalar import mean, money, share, total
from tallymart.operators.ranking import quintile

# Segment names in report order.
SEGMENT_ORDER = [
    "Champions", "Loyal", "Potential Loyalists", "New Customers", "Promising",
    "Need Attention", "At Risk", "Can't Lose Them", "Hibernating", "Lost",
]


def frequency_score(frequency: Column) -> Column:
    return F.least(frequency, F.lit(5)).cast("bigint")


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment from the three scores: repeat buyers by frequency and recency, one-time buyers by recency and spend."""
    frequent = F.when(r >= 4, "Champions").when(r == 3, "Loyal").otherwise("Can't Lose Them")
    twice = F.when(r >= 3, "Potential Loyalists").otherwise("At Risk")
    once = (
        F.when(r == 5, "New Customers")
        .when((r == 4) & (m >= 3), "Promising")
        .when((r == 4) | ((r == 3) & (m >= 4)), "Need Attention")
        .when((r == 3) | (m >= 4), "Hibernating")
        .otherwise("Lost")
    )
    return F.when(f >= 3, frequent).when(f == 2, twice).otherwise(once)


def rfm(features: DataFrame) -> DataFrame:
    """Scores and segment per customer of one snapshot. Equal values rank by customer id."""
    df = features.select("customer_unique_id", "recency_days", "frequency", "monetary")
    df = quintile(df, F.col("recency_days"), "customer_unique_id", "R", descending=True)
    df = df.withColumn("F", frequency_score(F.col("frequency")))
    df = quintile(df, F.col("monetary"), "customer_unique_id", "M")
    digits = [F.col(c).cast("string") for c in ("R", "F", "M")]
    return df.withColumns({
        "rfm_score": F.concat(*digits), "segment": segment_of(F.col("R"), F.col("F"), F.col("M")),
    })


def segment_summary(scored: DataFrame) -> DataFrame:
    """Size and value of each segment that occurs, in the fixed order."""
    everything = Window.partitionBy(F.lit(0))  # at most one row per segment
    out = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        mean(money("monetary")).alias("avg_monetary"),
        total(money("monetary")).alias("revenue"),
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SEGMENT_ORDER]), F.col("segment"))
    return out.withColumns({
        "share_customers": share(F.col("customers"), F.sum("customers").over(everything)),
        "share_revenue": share(F.col("revenue"), F.sum("revenue").over(everything)),
    }).orderBy(order)
