"""Behavioural customer clusters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymart.config import Config
from tallymart.operators import kmeans
from tallymart.session import stage_table

# Inputs of the clusters.
FEATURES = (
    "recency_days", "frequency", "monetary", "avg_order_value", "avg_items", "avg_review",
    "avg_delivery_days", "late_rate", "avg_installments", "freight_ratio",
)
SKEWED = ("frequency", "monetary", "avg_order_value", "avg_items", "avg_delivery_days")


def scaler() -> Pipeline:
    """Logs of the skewed columns, then zero mean and unit deviation, in column `scaled`."""
    def value(c: str) -> str:
        number = f"coalesce(CAST({c} AS DOUBLE), 0D)"
        return f"log1p(greatest({number}, 0D))" if c in SKEWED else number

    exprs = ", ".join(f"{value(c)} AS z_{c}" for c in FEATURES)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"),
        VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
    ])


def _fit_best(scaled: DataFrame, ks: list[int], config: Config) -> dict[int, kmeans.Fitted]:
    """Per k the run of least cost over the restarts, all fitted in the same reads of `scaled`."""
    sample = kmeans.sample_points(scaled, "scaled", config.seed, kmeans.START_SAMPLE)
    if not len(sample):
        raise ValueError("there are no customers to cluster")
    starts = {
        kmeans.Run(k, i): kmeans.spread_start(sample, k, config.seed + i)
        for k in ks for i in range(config.kmeans_restarts)
    }
    return kmeans.best_runs(kmeans.fit_all(scaled, "scaled", starts))


def _scaled(prepare: PipelineModel, features: DataFrame) -> DataFrame:
    """The prepared inputs as arrays, written once and kept in memory; every iteration reads them."""
    arrays = prepare.transform(features).select(vector_to_array("scaled").alias("scaled"))
    return stage_table(arrays, "scaled").persist()


def _scores(scaled: DataFrame, best: dict[int, kmeans.Fitted], config: Config) -> DataFrame:
    centers = {k: f.centers for k, f in best.items()}
    squared = kmeans.squared_silhouettes(scaled, "scaled", centers)
    plain = kmeans.plain_silhouettes(scaled, "scaled", centers, config.seed)
    rows = [(k, best[k].cost, squared[k], plain[k]) for k in sorted(best)]
    columns = "k int, inertia double, silhouette double, silhouette_plain double"
    return scaled.sparkSession.createDataFrame(rows, columns).orderBy("k")


def choose_k(features: DataFrame, config: Config) -> DataFrame:
    """Per k the least cost and two silhouettes: of squared distances over all customers, which is linear in the rows,
    and of plain distances on a sample of bounded size."""
    scaled = _scaled(scaler().fit(features), features)
    scores = _scores(scaled, _fit_best(scaled, list(config.ks), config), config)
    scaled.unpersist()
    return scores


def nearest(centers: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> SQLTransformer:
    """A pipeline stage that adds `cluster`, the number of the nearest centre, from the inputs `z_*` of `scaler`."""
    def square(center: np.ndarray) -> str:
        terms = []
        for c, at, mean, deviation in zip(FEATURES, center.tolist(), means.tolist(), deviations.tolist(), strict=True):
            # an input that never varies is scaled to 0
            scaled = f"(z_{c} - ({mean!r}D)) / {deviation!r}D" if deviation else "0D"
            terms.append(f"pow({scaled} - ({at!r}D), 2)")
        return " + ".join(terms)

    away = f"array({', '.join(square(c) for c in centers)})"
    return SQLTransformer(statement=(
        f"SELECT *, CAST(array_position(_away, array_min(_away)) - 1 AS INT) AS cluster FROM (SELECT *, {away} AS _away FROM __THIS__)"
    ))


def best_k(scores: DataFrame) -> int:
    """The k of highest silhouette; the smallest wins ties."""
    return scores.orderBy(F.desc("silhouette"), "k").first()["k"]


@dataclass(frozen=True)
class Clusters:
    assigned: DataFrame  # customer_unique_id, cluster, cluster_name
    profile: DataFrame
    model: PipelineModel
    scores: DataFrame | None
    centers: np.ndarray  # in scaled space, one row per cluster


def profile_of(assigned: DataFrame) -> DataFrame:
    """Size and mean features per cluster; `assigned` has `cluster` and the features."""
    means = [F.avg(c).alias(c) for c in FEATURES]
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("customers"), *means)


def named_profile(profile: DataFrame) -> DataFrame:
    """Add a readable name from what sets each cluster apart; repeated names are numbered in cluster order."""
    everything = Window.partitionBy(F.lit(0))  # one row per cluster

    def z(c: str) -> Column:
        spread = F.stddev_pop(c).over(everything)
        gap = F.col(c) - F.avg(c).over(everything)
        return gap / F.when(spread == 0, 1.0).otherwise(spread)

    for c in ("late_rate", "avg_review", "avg_items", "monetary", "avg_installments"):
        profile = profile.withColumn(f"_z_{c}", z(c))
    base = (
        F.when(F.col("frequency") >= 1.5, "Repeat buyers")
        .when((F.col("_z_late_rate") > 1) | (F.col("_z_avg_review") < -1), "Unhappy (late delivery / low review)")
        .when(F.col("_z_avg_items") > 1, "Multi-item baskets")
        .when(F.col("_z_monetary") > 1, "High spenders")
        .when(F.col("_z_avg_installments") > 0.5, "Installment shoppers")
        .when(F.col("_z_monetary") < -0.5, "Budget one-timers")
        .otherwise("Regular one-timers")
    )
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("cluster"))
    named = profile.withColumn("_base", base).withColumn("_nth", nth)
    name = F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws(" ", "_base", F.col("_nth").cast("string")))
    return named.withColumn("cluster_name", name).select(
        "cluster", "cluster_name", "customers", *FEATURES
    ).orderBy("cluster")


def cluster(features: DataFrame, config: Config, k: int | None = None) -> Clusters:
    """Assign every customer to one of k clusters; without k the best silhouette decides."""
    scores = None
    if k is None:
        scores = choose_k(features, config)
        k = best_k(scores)
    prepare = scaler().fit(features)
    scaled = _scaled(prepare, features)
    centers = _fit_best(scaled, [k], config)[k].centers
    scaled.unpersist()
    standard = prepare.stages[-1]
    full = PipelineModel(stages=[*prepare.stages, nearest(centers, standard.mean.toArray(), standard.std.toArray())])
    labels = full.transform(features).select("customer_unique_id", "cluster", *FEATURES)
    profile = named_profile(profile_of(labels))
    names = profile.select("cluster", "cluster_name")
    assigned = labels.select("customer_unique_id", "cluster").join(F.broadcast(names), "cluster")  # k rows
    return Clusters(assigned.select("customer_unique_id", "cluster", "cluster_name"), profile, full, scores, centers)
