"""Customer list, target list and point lookups over the stored customer table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.scalar import total

# Names of the interface.
SORTS = ("clv_12m", "churn_risk", "p_repeat", "monetary", "recency_days")
LIST_COLUMNS = (
    "customer_unique_id", "customer_state", "segment", "cluster_name", "frequency", "monetary", "recency_days",
    "p_repeat", "churn_risk", "risk_band", "clv_12m", "clv_tier",
)
TARGET_COLUMNS = tuple(c for c in LIST_COLUMNS if c != "churn_risk")


def _available(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def filter_customers(
    customers: DataFrame,
    segments: Sequence[str] = (),
    risk_bands: Sequence[str] = (),
    clv_tiers: Sequence[str] = (),
) -> DataFrame:
    """Customers whose values are among those given; an empty list does not filter."""
    for name, values in (("segment", segments), ("risk_band", risk_bands), ("clv_tier", clv_tiers)):
        if values:
            customers = customers.where(F.col(name).isin(*values))
    return customers


def customer_list(
    customers: DataFrame,
    segment: str | None = None,
    risk_band: str | None = None,
    clv_tier: str | None = None,
    sort_by: str = "clv_12m",
    limit: int = 50,
) -> DataFrame:
    """The first `limit` customers by `sort_by`, highest first, each with the total number that match."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {', '.join(SORTS)}")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found = filter_customers(
        customers, *[[v] if v else [] for v in (segment, risk_band, clv_tier)]
    )
    matched = found.agg(F.count(F.lit(1))).scalar()
    first = found.orderBy(F.desc(sort_by), "customer_unique_id").limit(limit)
    return first.select(*_available(customers, LIST_COLUMNS)).withColumn("total", matched)


def target_list(
    customers: DataFrame,
    segments: Sequence[str] = (),
    risk_bands: Sequence[str] = (),
    clv_tiers: Sequence[str] = (),
    sort_by: str = "clv_12m",
    limit: int | None = None,
) -> DataFrame:
    """The matching customers, most recent first for recency, else highest first; the first `limit` if given."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {', '.join(SORTS)}")
    found = filter_customers(customers, segments, risk_bands, clv_tiers)
    key = F.asc(sort_by) if sort_by == "recency_days" else F.desc(sort_by)
    ranked = found.orderBy(key, "customer_unique_id").select(*_available(customers, TARGET_COLUMNS))
    return ranked if limit is None else ranked.limit(limit)


def target_summary(customers: DataFrame, *filters: Sequence[str]) -> DataFrame:
    """How many customers match and what they are expected to bring."""
    return filter_customers(customers, *filters).agg(
        F.count(F.lit(1)).alias("matched"), total("clv_12m").alias("expected_clv"),
        total("p_repeat").alias("expected_repeaters"),
    )


def customer_by_id(customers: DataFrame, customer_unique_id) -> DataFrame:
    """The row of one customer; no row when there is none."""
    return customers.where(F.col("customer_unique_id") == F.lit(customer_unique_id))
