"""Business reports over the star schema. Null group keys are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymart.functions.scalar import flag, mean, month_start, share, total, week_start


def _report():
    """One window over all rows: only for report rows (states, tiers), never for facts."""
    return Window.partitionBy(F.lit(0))


def kpis(facts: DataFrame, customers: DataFrame) -> DataFrame:
    """One row with the headline numbers and the data window."""
    repeat = customers.agg(
        F.struct(
            F.count(F.lit(1)).alias("customers"), F.avg(flag(F.col("n_orders") > 1)).alias("rate")
        ).alias("c")
    )
    one = facts.agg(
        F.count(F.lit(1)).alias("orders"),
        total("payment_value").alias("revenue"),
        mean("payment_value").alias("avg_order_value"),
        mean("review_score").alias("avg_review_score"),
        F.avg(flag(F.col("is_late"))).alias("late_delivery_rate"),
        mean("delivery_days").alias("avg_delivery_days"),
        F.min("order_date").cast("string").alias("data_start"),
        F.max("order_date").cast("string").alias("data_end"),
    ).withColumn("c", repeat.scalar())
    return one.select(
        "orders", F.col("c.customers").alias("customers"), "revenue", "avg_order_value",
        F.col("c.rate").alias("repeat_customer_rate"), "avg_review_score", "late_delivery_rate",
        "avg_delivery_days", "data_start", "data_end",
    )


def state_performance(facts: DataFrame) -> DataFrame:
    """Sales and logistics per state, highest revenue first."""
    out = facts.where(F.col("customer_state").isNotNull()).groupBy("customer_state").agg(
        F.count("order_id").alias("orders"),
        F.countDistinct("customer_unique_id").alias("customers"),
        total("payment_value").alias("revenue"),
        mean("payment_value").alias("avg_order_value"),
        mean("freight_value").alias("avg_freight"),
        mean("delivery_days").alias("avg_delivery_days"),
        F.avg(flag(F.col("is_late"))).alias("late_rate"),
        mean("review_score").alias("avg_review"),
    )
    return out.withColumns({
        "revenue_share": share(F.col("revenue"), F.sum("revenue").over(_report())),
        "freight_ratio": share(F.col("avg_freight"), F.col("avg_order_value")),
    }).orderBy(F.desc("revenue"), "customer_state")


def busy_states(states: DataFrame, min_orders: int = 200) -> DataFrame:
    return states.where(F.col("orders") >= min_orders)


def monthly_state_revenue(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("customer_state").isNotNull())
        .groupBy(month_start("order_date").alias("month"), "customer_state")
        .agg(total("payment_value").alias("payment_value"))
    )


def category_performance(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Units, revenue, price and item-weighted review per category, highest revenue first.

    The review sums are taken per (order, category) before the join, so a large order sends one row per
    category and no order key is hot.
    """
    per_order = items.groupBy("order_id", "category").agg(
        F.count("order_item_id").alias("units"), F.count(F.lit(1)).alias("n"),
        F.sum("price").alias("price"), F.count("price").alias("priced"),
    )
    joined = per_order.join(facts.select("order_id", "review_score"), "order_id")
    rated = F.when(F.col("review_score").isNotNull(), F.col("n"))
    return (
        joined.groupBy("category")
        .agg(
            F.sum("units").alias("units"),
            total("price").alias("revenue"),
            F.try_divide(F.sum("price").cast("double"), F.sum("priced")).alias("avg_price"),
            F.try_divide(
                F.sum(F.col("review_score") * F.col("n")).cast("double"), F.sum(rated)
            ).alias("avg_review"),
        )
        .orderBy(F.desc("revenue"), "category")
    )


def weekly_orders(facts: DataFrame) -> DataFrame:
    """Orders per Monday-labelled week, weeks without orders as 0."""
    counts = facts.groupBy(week_start("order_date").alias("week")).agg(F.count("order_id").alias("orders"))
    weeks = counts.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).where("lo IS NOT NULL")
    grid = weeks.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week"))
    return grid.join(counts, "week", "left").select("week", F.coalesce("orders", F.lit(0)).alias("orders")).orderBy(
        "week"
    )


def orders_by_weekday(facts: DataFrame) -> DataFrame:
    d = F.col("order_purchase_timestamp").cast("date")
    return (
        facts.groupBy(F.weekday(d).cast("bigint").alias("dayofweek"), F.date_format(d, "EEEE").alias("weekday"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("dayofweek")
    )


def counts_by_hour(df: DataFrame, ts: str, name: str = "orders") -> DataFrame:
    return df.groupBy(F.hour(ts).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias(name)).orderBy("hour")


def top_categories_by_revenue(items: DataFrame, n: int = 15) -> DataFrame:
    return (
        items.groupBy("category")
        .agg(F.count("price").alias("items"), total("price").alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
        .limit(n)
    )


def state_revenue_thousands(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg((total("payment_value") / 1000).alias("revenue_k"))
        .orderBy(F.desc("revenue_k"), "customer_state")
    )


def review_distribution(facts: DataFrame) -> DataFrame:
    rated = facts.where(F.col("review_score").isNotNull())
    return rated.groupBy(F.col("review_score").cast("bigint").alias("review_score")).agg(
        F.count(F.lit(1)).alias("orders")
    ).orderBy("review_score")


def review_by_lateness(facts: DataFrame) -> DataFrame:
    return facts.groupBy("is_late").agg(mean("review_score").alias("avg_review")).orderBy("is_late")


def orders_per_customer(customers: DataFrame, first: int = 8) -> DataFrame:
    return customers.groupBy("n_orders").agg(F.count(F.lit(1)).alias("customers")).orderBy("n_orders").limit(first)


def state_delivery_summary(facts: DataFrame, first: int = 12) -> DataFrame:
    """The states with the most orders, values rounded to two places."""
    return (
        facts.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.count("order_id").alias("orders"),
            F.round(mean("delivery_days"), 2).alias("avg_days"),
            F.round(F.avg(flag(F.col("is_late"))), 2).alias("late_rate"),
            F.round(mean("review_score"), 2).alias("review"),
        )
        .orderBy(F.desc("orders"), "customer_state")
        .limit(first)
    )


def clv_by_segment(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.avg("clv_12m").alias("avg_clv"),
            F.sum("clv_12m").alias("total_clv"),
            F.avg("p_repeat").alias("p_repeat"),
        )
        .orderBy(F.desc("avg_clv"), "segment")
    )


def rm_matrix(customers: DataFrame) -> DataFrame:
    """Recency score by monetary score: mean value and count per cell, best recency first."""
    cells = customers.groupBy("R").pivot("M", [1, 2, 3, 4, 5]).agg(
        F.avg("clv_12m").alias("avg_clv"), F.count("clv_12m").alias("customers")
    )
    names = {f"{m}_{v}": f"m{m}_{v}" for m in range(1, 6) for v in ("avg_clv", "customers")}
    cells = cells.withColumnsRenamed(names)
    return cells.fillna(0, [f"m{m}_customers" for m in range(1, 6)]).orderBy(F.desc("R"))


def segment_cluster_crosstab(customers: DataFrame, segment_order: list[str]) -> DataFrame:
    """Customers per segment and cluster; every cluster name of the table (one per cluster) is a column."""
    cluster_names = [r[0] for r in customers.select("cluster_name").distinct().orderBy("cluster_name").collect()]
    order = F.array_position(F.array(*[F.lit(s) for s in segment_order]), F.col("segment"))
    table = customers.groupBy("segment").pivot("cluster_name", cluster_names).count().fillna(0)
    return table.orderBy(order)


def basket_mix(facts: DataFrame) -> DataFrame:
    """Shares of single-item and single-category orders."""
    return facts.agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg(flag(F.col("n_items") == 1)).alias("single_item_share"),
        F.avg(flag(F.col("n_categories") == 1)).alias("single_category_share"),
    )


def repeat_by_frequency(customers: DataFrame) -> DataFrame:
    """Mean repeat probability by order count."""
    return customers.groupBy("frequency").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("p_repeat").alias("avg_p_repeat")
    ).orderBy("frequency")


def clv_share_by_tier(customers: DataFrame) -> DataFrame:
    """Share of the expected value held by each tier."""
    tiers = customers.groupBy("clv_tier").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("clv_12m").alias("total_clv")
    )
    return tiers.withColumn("share_clv", share(F.col("total_clv"), F.sum("total_clv").over(_report())))


def score_calibration(scored: DataFrame) -> DataFrame:
    """Mean predicted against observed repeat rate; `scored` has p_repeat and repeat."""
    return scored.agg(
        F.avg("p_repeat").alias("mean_predicted"), F.avg(F.col("repeat").cast("double")).alias("observed_rate")
    )


def first_rows(report: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of a ranked report."""
    return report.orderBy(*order).limit(n)
