"""Cleaning of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.config import UNKNOWN, Config
from tallymart.functions.scalar import elapsed_days, midnight, money

# Categories that are in use but missing from the translation table.
EXTRA_TRANSLATIONS = {
    "pc_gamer": "pc_gamer",
    "portateis_cozinha_e_preparadores_de_alimentos": "portable_kitchen_food_preparers",
}


def first_per_key(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One whole row per key: the smallest by `order`, then by all other columns.

    A grouped minimum combines map-side, so a key with very many copies never gathers in one task.
    """
    order = order or []
    rest = [c for c in df.columns if c != key and c not in order]
    kept = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return kept.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def clean_orders(orders: DataFrame, config: Config, delivered_only: bool = True) -> DataFrame:
    """Unique orders of the kept status inside the window, with delivery delays."""
    bought = F.col("order_purchase_timestamp")
    window_end = midnight(F.date_add(F.lit(config.end), 1))
    # The earliest copy of an order is kept, so copies after the window cannot matter and need no shuffle.
    # Earlier copies and those without a time can: they take their order out of the window.
    df = orders.where(bought.isNull() | (bought < window_end))
    df = first_per_key(df, "order_id", ["order_purchase_timestamp"])
    if delivered_only:
        df = df.where(F.col("order_status") == config.kept_status)
    df = df.where((bought >= midnight(F.lit(config.start))) & (bought < window_end))
    df = df.withColumns({
        "delivery_days": elapsed_days("order_delivered_customer_date", bought),
        "delay_days": elapsed_days("order_delivered_customer_date", "order_estimated_delivery_date"),
    })
    return df.withColumn("is_late", F.coalesce(F.col("delay_days") > 0, F.lit(False)))


def clean_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Unique products with an English category; unmapped ones are `unknown`."""
    source, english = translation.columns[:2]
    names = translation.select(F.col(source).alias("product_category_name"), F.col(english).alias("category"))
    extras = F.create_map(*[F.lit(x) for pair in EXTRA_TRANSLATIONS.items() for x in pair])
    names = names.groupBy("product_category_name").agg(F.max("category").alias("category"))
    df = first_per_key(products, "product_id").join(names, "product_category_name", "left")
    df = df.withColumn(
        "category", F.coalesce(extras[F.col("product_category_name")], F.col("category"), F.lit(UNKNOWN))
    )
    return df.select(*products.columns, "category").withColumnsRenamed({
        "product_name_lenght": "product_name_length",
        "product_description_lenght": "product_description_length",
    })


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """One review per order: the last answered, where a missing answer time counts as last."""
    answered = F.col("review_answer_timestamp")
    rest = [c for c in reviews.columns if c not in ("order_id", "review_answer_timestamp", "review_id")]
    last = F.max(F.struct(answered.isNull().alias("_open"), answered, "review_id", *rest))
    kept = reviews.groupBy("order_id").agg(last.alias("_row"))
    return kept.select(*[
        F.col("order_id") if c == "order_id" else F.col("_row")[c].alias(c) for c in reviews.columns
    ])


def clean_payments(payments: DataFrame) -> DataFrame:
    """One row per order: paid value, most installments, row count, type of the largest payment."""
    value = money("payment_value")
    largest = F.max(F.struct(value.alias("value"), F.col("payment_type").alias("type")))
    return payments.groupBy("order_id").agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("decimal(28,4)").alias("payment_value"),
        F.max("payment_installments").cast("bigint").alias("payment_installments"),
        F.count("payment_sequential").alias("n_payments"),
        largest["type"].alias("payment_type"),
    )
