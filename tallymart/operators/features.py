"""Point-in-time customer features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.functions.scalar import calendar_days, column_name, flag, log1p_clipped, midnight
from tallymart.operators.months import bought_between
from tallymart.operators.ranking import medians
from tallymart.session import stage_table


# What a mean is taken of, by the name of the mean.
MEANS = {
    "avg_order_value": "payment_value", "avg_items": "n_items", "avg_freight": "freight_value",
    "avg_review": "review_score", "avg_delivery_days": "delivery_days", "late_rate": "_late",
    "avg_installments": "payment_installments", "credit_card_share": "_card",
}


def _ascending(snapshots: Column) -> Column:
    return F.sort_array(F.array_distinct(snapshots))


def _with_interval(facts: DataFrame, snapshots: Column) -> DataFrame:
    """`_interval` is the number of snapshots at or before the order, which all later snapshots see.

    Snapshots are nested, so an order is aggregated once, in its interval, and not once per snapshot.
    """
    bought = F.col("order_purchase_timestamp")
    passed = F.size(F.filter(F.col("_days"), lambda s: midnight(s) <= bought))
    dated = bought_between(facts, None, F.array_max(snapshots))
    return dated.withColumn("_days", _ascending(snapshots)).withColumn("_interval", passed).drop("_days")


def _per_snapshot(aggregated: DataFrame, snapshots: Column) -> DataFrame:
    """Each aggregate of an interval once for every snapshot after it."""
    days = _ascending(snapshots)
    later = F.explode(F.slice(days, F.col("_interval") + 1, F.size(days)))
    return aggregated.withColumn("snapshot", later).drop("_interval")


SUMS = (*dict.fromkeys(MEANS.values()), "n_categories")


def order_partials(facts: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """One row per group of orders from which the features of any union of groups can be made (see `merge_partials`).

    Orders without a customer are a group of their own.
    """
    bought = F.col("order_purchase_timestamp")
    df = facts.withColumns({
        "_late": flag(F.col("is_late")), "_card": flag(F.col("payment_type") == config.card_type),
        "_known_at": F.when(F.col("customer_state").isNotNull(), F.struct("order_purchase_timestamp", "order_id")),
    })
    return df.groupBy(*keys).agg(
        F.min(bought).alias("first_order"), F.max(bought).alias("last_order"),
        F.count("order_id").alias("frequency"),  # order_id is unique in the facts
        F.max_by("customer_state", "_known_at").alias("customer_state"), F.max("_known_at").alias("_known_at"),
        *[F.sum(c).alias(f"_sum_{c}") for c in SUMS], *[F.count(c).alias(f"_n_{c}") for c in SUMS],
    )


def merge_partials(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The partials of larger groups from those of smaller ones."""
    return parts.groupBy(*keys).agg(
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"),
        F.sum("frequency").alias("frequency"), F.max_by("customer_state", "_known_at").alias("customer_state"),
        F.max("_known_at").alias("_known_at"),
        *[F.sum(f"_{kind}_{c}").alias(f"_{kind}_{c}") for c in SUMS for kind in ("sum", "n")],
    )


def customer_features(facts: DataFrame, config: Config, snapshots: Column | None = None) -> DataFrame:
    """One row per (snapshot, customer) from the orders before the snapshot.

    `snapshots` is an array of days (a literal or a scalar subquery); the default is the day after the last
    order. Orders are aggregated per interval between snapshots, and those aggregates are merged for each snapshot.
    The result is written once, since the medians that fill the gaps read it again. Only the state and the average
    order value can be missing.
    """
    key = "customer_unique_id"
    if snapshots is None:
        # orders without a customer count for the last day, as a group that is dropped below
        raw = stage_table(raw_features(order_partials(facts, [key], config), [key]), "customer_features")
        # the default lies after every order, so it excludes none and can be read off the aggregate
        named = raw.withColumn("snapshot", raw.agg(F.date_add(F.max(F.col("last_order").cast("date")), 1)).scalar())
        return filled_features(named.where(F.col(key).isNotNull()).select("snapshot", *raw.columns))
    dated = _with_interval(facts.where(F.col(key).isNotNull()), snapshots)
    parts = _per_snapshot(order_partials(dated, ["_interval", key], config), snapshots)
    keys = ["snapshot", key]
    return filled_features(stage_table(raw_features(merge_partials(parts, keys), keys), "customer_features"))


def raw_features(merged: DataFrame, keys: list[str]) -> DataFrame:
    """What follows from the orders of a group alone."""
    return merged.select(
        *keys, "first_order", "last_order", "frequency",
        F.coalesce("_sum_payment_value", F.lit(0)).cast("double").alias("monetary"),
        *[F.try_divide(F.col(f"_sum_{c}").cast("double"), F.col(f"_n_{c}")).alias(n) for n, c in MEANS.items()],
        F.coalesce("_sum_n_categories", F.lit(0)).alias("n_categories"), "customer_state",
    )


def filled_features(raw: DataFrame) -> DataFrame:
    """Raw features with gaps filled and days since the orders. `raw` is a stored table: it is read twice."""
    mids = medians(raw, "snapshot", ["avg_review", "avg_delivery_days"]).select(
        "snapshot", F.col("avg_review").alias("_review"), F.col("avg_delivery_days").alias("_days")
    )
    filled = raw.join(F.broadcast(mids), "snapshot", "left")  # one row per snapshot
    snap = F.col("snapshot")
    aov = F.col("avg_order_value")
    return filled.withColumns({
        "avg_review": F.coalesce("avg_review", "_review"),
        "avg_delivery_days": F.coalesce("avg_delivery_days", "_days"),
        "avg_installments": F.coalesce("avg_installments", F.lit(1.0)),
        "recency_days": calendar_days(snap, "last_order"),
        "tenure_days": calendar_days(snap, "first_order"),
        "freight_ratio": F.coalesce(F.try_divide(F.col("avg_freight"), aov), F.lit(0.0)),
    }).drop("_review", "_days")


def main_category(items: DataFrame, snapshots: Column) -> DataFrame:
    """Per (snapshot, customer) the category bought most before the snapshot; ties go to the last name."""
    known = _with_interval(items.where(F.col("customer_unique_id").isNotNull()), snapshots)
    part = known.groupBy("_interval", "customer_unique_id", "category").agg(F.count(F.lit(1)).alias("n"))
    counts = _per_snapshot(part, snapshots).groupBy("snapshot", "customer_unique_id", "category").agg(
        F.sum("n").alias("n"))
    return counts.groupBy("snapshot", "customer_unique_id").agg(
        F.max(F.struct("n", "category"))["category"].alias("main_category")
    )


def category_columns(config: Config) -> list[str]:
    return [column_name("cat_", c) for c in config.repeat_categories]


def with_categories(features: DataFrame, items: DataFrame | None, config: Config, snapshots: Column) -> DataFrame:
    """One 0/1 column per listed category; all 0 for customers without items or without an item table."""
    names = category_columns(config)
    if items is None:
        return features.withColumns({n: F.lit(0).cast("bigint") for n in names})
    joined = features.join(main_category(items, snapshots), ["snapshot", "customer_unique_id"], "left")
    return joined.withColumns({
        n: flag(F.col("main_category") == c).cast("bigint")
        for n, c in zip(names, config.repeat_categories, strict=True)
    })


def with_state_flags(features: DataFrame, config: Config) -> DataFrame:
    state = F.col("customer_state")
    return features.withColumns({
        "is_sp": flag(state.isin(*config.home_states)).cast("bigint"),
        "is_rj_mg": flag(state.isin(*config.neighbour_states)).cast("bigint"),
    })


def log_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """Replace skewed columns by log(1 + x), negatives as 0."""
    return df.withColumns({n: log1p_clipped(n) for n in names})
