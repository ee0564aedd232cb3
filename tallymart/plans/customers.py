"""The customer stage: features, segments, clusters, propensity and value in one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tallymart.config import Config
from tallymart.operators import clusters, clv, features, propensity, rfm
from tallymart.operators.warehouse import Warehouse
from tallymart.session import stage_table


@dataclass(frozen=True)
class CustomerStage:
    customers: DataFrame
    segment_summary: DataFrame
    cluster_profile: DataFrame
    cluster_k_scores: DataFrame | None
    churn_metrics: DataFrame
    churn_importance: DataFrame
    kmeans: PipelineModel
    churn_model: PipelineModel


def build(warehouse: Warehouse, config: Config, k: int | None = None) -> CustomerStage:
    """Build all customer tables. Without `k` the number of clusters comes from the silhouette on a sample."""
    stored = warehouse.staged("fact_orders")  # the facts are read many times
    facts, items = stored.fact_orders, stored.fact_order_items
    feats = stage_table(features.customer_features(facts, config), "features")
    scores = stage_table(rfm.rfm(feats), "rfm")
    grouped = clusters.cluster(feats, config, k)

    trained = propensity.train_and_evaluate(facts, items, config)
    scored = propensity.score_features(trained.model, feats, items, config)
    cut = propensity.train_cutoffs(propensity.test_cutoff(facts, config), config)[-1]
    valued = clv.clv(scored, clv.orders_per_repeater(facts, cut, config).scalar(), config)

    key = "customer_unique_id"
    customers = (
        feats.drop("snapshot")
        .join(scores.select(key, "R", "F", "M", "rfm_score", "segment"), key)
        .join(grouped.assigned, key)
        .join(valued.select(
            key, "p_repeat", "churn_risk", "risk_band", "expected_orders_12m", "clv_12m", "clv_tier"
        ), key)
    )
    return CustomerStage(
        customers=customers,
        segment_summary=rfm.segment_summary(scores),
        cluster_profile=grouped.profile,
        cluster_k_scores=grouped.scores,
        churn_metrics=trained.metrics,
        churn_importance=propensity.importance(trained.model, config),
        kmeans=grouped.model,
        churn_model=trained.model,
    )
