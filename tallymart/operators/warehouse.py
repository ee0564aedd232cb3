"""Star schema: two fact tables and three dimensions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.config import UNKNOWN, Config
from tallymart.functions.scalar import total
from tallymart.operators.calendar import dim_date
from tallymart.operators.cleaning import (
    clean_orders,
    clean_payments,
    clean_products,
    clean_reviews,
    first_per_key,
)
from tallymart.operators.joins import many_to_one
from tallymart.session import stage_table


class Warehouse:
    """The five tables. Each is planned when first asked for and runs only when it is written or read."""

    NAMES = ("fact_orders", "fact_order_items", "dim_customer", "dim_product", "dim_date")

    def __init__(self, sources: dict[str, DataFrame], config: Config, holidays: DataFrame | None = None):
        self._sources, self._config, self._holidays = sources, config, holidays

    @cached_property
    def dim_product(self) -> DataFrame:
        return clean_products(self._sources["products"], self._sources["translation"])

    @cached_property
    def _items(self) -> DataFrame:
        return categorised_items(self._sources["items"], self.dim_product)

    @cached_property
    def fact_orders(self) -> DataFrame:
        return fact_orders(
            clean_orders(self._sources["orders"], self._config),
            first_per_key(self._sources["customers"], "customer_id"),
            clean_reviews(self._sources["reviews"]),
            clean_payments(self._sources["payments"]),
            item_totals(self._items),
        )

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return fact_order_items(self._items, self.fact_orders)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return dim_customer(self.fact_orders)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dim_date(self.fact_orders, self._holidays)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}

    def with_fact_orders(self, stored: DataFrame) -> Warehouse:
        """The same warehouse whose other tables build on the given orders."""
        other = Warehouse(self._sources, self._config, self._holidays)
        other.__dict__["fact_orders"] = stored
        return other

    def staged(self, *names: str) -> Warehouse:
        """The same warehouse with the named tables written to the shared scratch area."""
        other = Warehouse(self._sources, self._config, self._holidays)
        for name in names:
            # a stored value takes the place of the planned one, also for the tables built on it
            other.__dict__[name] = stage_table(getattr(other, name), name)
        return other


def categorised_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the category of their product; unlisted products are `unknown`."""
    df = many_to_one(items, products.select("product_id", "category"), "product_id")
    return df.withColumn("category", F.coalesce("category", F.lit(UNKNOWN)))


def item_totals(items: DataFrame) -> DataFrame:
    """Per order: item count, value, freight and number of categories.

    The set of categories of one order is bounded by the category list and shrinks map-side, which saves
    the second shuffle of all items that a distinct count needs.
    """
    return items.groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("decimal(28,4)").alias("items_value"),
        F.coalesce(F.sum("freight_value"), F.lit(0)).cast("decimal(28,4)").alias("freight_value"),
        F.size(F.collect_set("category")).cast("bigint").alias("n_categories"),
    )


def fact_orders(
    orders: DataFrame, customers: DataFrame, reviews: DataFrame, payments: DataFrame, totals: DataFrame
) -> DataFrame:
    """Kept orders that have items. The joins on order_id share one partitioning; the customer join is last."""
    df = (
        orders.join(totals, "order_id", "inner")
        .join(reviews.select("order_id", "review_score"), "order_id", "left")
        .join(payments, "order_id", "left")
    )
    df = many_to_one(df, customers, "customer_id")
    return df.withColumn("order_date", F.col("order_purchase_timestamp").cast("date"))


def fact_order_items(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items of the kept orders."""
    head = facts.select(
        "order_id", "customer_unique_id", "customer_state", "order_purchase_timestamp", "order_date"
    )
    return many_to_one(items, head, "order_id", "inner")


def dim_customer(facts: DataFrame) -> DataFrame:
    """One row per person: latest known state and city, order dates, orders, spend."""
    def latest(c: str):
        when = F.struct("order_purchase_timestamp", "order_id")
        return F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c)

    return facts.where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(
        latest("customer_state"),
        latest("customer_city"),
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
        F.count("order_id").alias("n_orders"),  # order_id is unique in the facts
        total("payment_value").alias("total_spent"),
    )


def build(sources: dict[str, DataFrame], config: Config, holidays: DataFrame | None = None) -> Warehouse:
    return Warehouse(sources, config, holidays)
