"""The whole job: star schema, forecasts, customers and reports, written to a folder."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tallymart.config import Config
from tallymart.operators import affinity, customer_state, insights, months
from tallymart.operators.warehouse import Warehouse
from tallymart.plans import customers, forecasts
from tallymart.session import staging_scope
from tallymart.sources.tables import read_table, write_csv, write_json, write_model, write_tables

STAGES = ("warehouse", "forecasting", "customers", "insights")
FACTS = ("fact_orders", "fact_order_items")


class StoredWarehouse(Warehouse):
    """A warehouse that an earlier run has written."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._opened = spark, folder, {}

    def staged(self, *names: str) -> Warehouse:
        return self

    def __getattribute__(self, name):
        if name in Warehouse.NAMES:
            if name not in self._opened:  # files are listed and their schema is read once
                # facts by month keep that column: bounds on the purchase time then reach the folders
                self._opened[name] = read_table(self._spark, self._folder, name)
            return self._opened[name]
        return super().__getattribute__(name)


def write_warehouse(warehouse: Warehouse, folder: str, by_month: bool = False) -> None:
    """Write the five tables. `by_month` partitions the facts, for data that is read by date."""
    spark = warehouse.fact_orders.sparkSession

    def facts(df: DataFrame) -> DataFrame:
        return months.with_month(df) if by_month else df

    parts = {n: months.MONTH for n in FACTS} if by_month else None
    write_tables({"fact_orders": facts(warehouse.fact_orders)}, folder, parts)
    # the other tables start from the written orders instead of joining them again
    stored = read_table(spark, folder, "fact_orders").drop(months.MONTH)
    rest = warehouse.with_fact_orders(stored)
    write_tables({"fact_order_items": facts(rest.fact_order_items)}, folder, parts)
    write_tables({n: getattr(rest, n) for n in Warehouse.NAMES if n not in FACTS}, folder)


def features_at(spark: SparkSession, folder: str, days: Sequence[date], config: Config) -> DataFrame:
    """Customer features of any days from a job run with `by_month`: stored months, and the begun month's orders."""
    facts = read_table(spark, folder, "fact_orders")
    return customer_state.features(facts, f"{folder}/customer_state", days, config)


def insight_tables(warehouse: Warehouse, config: Config) -> dict[str, DataFrame]:
    facts, items = warehouse.fact_orders, warehouse.fact_order_items
    return {
        **{f"affinity_{level}": affinity.category_affinity(items, level, config.min_pair_count)
           for level in affinity.LEVELS},
        "state_performance": insights.state_performance(facts),
        "monthly_state_revenue": insights.monthly_state_revenue(facts),
        "category_performance": insights.category_performance(items, facts),
    }


def run(
    spark: SparkSession,
    sources: dict[str, DataFrame] | None,
    folder: str,
    config: Config,
    stages: Sequence[str] = STAGES,
    holidays: DataFrame | None = None,
    by_month: bool = False,
    k: int | None = None,
) -> None:
    """Run the named stages. Without `warehouse` among them the stored tables of an earlier run are read."""
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}; options: {', '.join(STAGES)}")
    if "warehouse" in stages:
        write_warehouse(Warehouse(sources, config, holidays), folder, by_month)
        if by_month:
            # all months are made again, as the facts were; later loads update only the months that they touch
            customer_state.update(read_table(spark, folder, "fact_orders"), f"{folder}/customer_state", config, every=True)
    with staging_scope(spark):
        _run_on(StoredWarehouse(spark, folder), spark, folder, config, stages, holidays, k)


def _run_on(stored, spark, folder, config, stages, holidays, k) -> None:
    write_json(insights.kpis(stored.fact_orders, stored.dim_customer), folder, "kpis")

    if "forecasting" in stages:
        made = forecasts.build(stored.fact_order_items, config, holidays)
        write_tables({n: v for n, v in vars(made).items() if isinstance(v, DataFrame)}, folder)
        write_csv(made.forecast, f"{folder}/forecast_csv")
        write_model(made.model, folder, "model_boosted_global")
    if "customers" in stages:
        done = customers.build(stored, config, k)
        write_tables({n: v for n, v in vars(done).items() if isinstance(v, DataFrame)}, folder)
        write_model(done.kmeans, folder, "model_kmeans_customers")
        write_model(done.churn_model, folder, "model_churn")
    if "insights" in stages:
        write_tables(insight_tables(stored, config), folder)
