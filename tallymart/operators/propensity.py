"""Repeat-purchase propensity with out-of-time validation.

At a cutoff day the features use orders before it, and the label says whether the customer orders again in
the window that starts with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.functions.scalar import column_name, flag, midnight
from tallymart.operators.features import (
    category_columns,
    customer_features,
    with_categories,
    with_state_flags,
)
from tallymart.operators.months import bought_between
from tallymart.operators.ranking import quintile, rows_at, with_running_totals
from tallymart.session import in_parallel, stage_table

NUMERIC = (
    "recency_days", "tenure_days", "frequency", "monetary", "avg_order_value", "avg_items", "avg_freight",
    "avg_review", "avg_delivery_days", "late_rate", "avg_installments", "n_categories", "credit_card_share",
    "freight_ratio", "is_sp", "is_rj_mg",
)
SKEWED = (
    "frequency", "monetary", "avg_order_value", "avg_items", "avg_freight", "n_categories", "avg_installments",
)
# Bands from the lowest to the highest repeat probability.
RISK_BANDS = ("very high", "high", "medium", "low", "very low")
LOGISTIC, TREES = "logistic", "gbt"
INVERSE_PENALTY = 0.5


def feature_names(config: Config) -> list[str]:
    return [*NUMERIC, *category_columns(config)]


def test_cutoff(facts: DataFrame, config: Config) -> Column:
    """The last day that leaves a whole label window, as a scalar subquery."""
    last = F.least(F.max(F.col("order_purchase_timestamp").cast("date")), F.lit(config.end))
    return facts.agg(F.date_sub(last, config.window_days)).scalar()


test_cutoff.__test__ = False  # not a test case


def train_cutoffs(cutoff: Column, config: Config) -> list[Column]:
    """Ascending; the label window of the last one ends at the test cutoff."""
    steps = range(config.train_cutoffs - 1, -1, -1)
    return [F.date_sub(cutoff, config.window_days + config.step_days * i) for i in steps]


def labelled(facts: DataFrame, items: DataFrame | None, cutoffs: Column, config: Config) -> DataFrame:
    """Features and the label `repeat` per (snapshot, customer), for all days in the array `cutoffs` at once."""
    feats = customer_features(facts, config, cutoffs)
    feats = with_state_flags(with_categories(feats, items, config, cutoffs), config)
    bought = F.col("order_purchase_timestamp")
    opened = F.filter(
        F.col("_cuts"),
        lambda c: (bought >= midnight(c)) & (bought < midnight(F.date_add(c, config.window_days))),
    )
    # only the orders that some label window can hold
    first, end = F.array_min(cutoffs), F.date_add(F.array_max(cutoffs), config.window_days)
    future = (
        bought_between(facts.where(F.col("customer_unique_id").isNotNull()), first, end)
        .withColumn("_cuts", cutoffs)
        .select("customer_unique_id", F.explode(opened).alias("snapshot"))
        .distinct()
        .withColumn("_again", F.lit(1))
    )
    joined = feats.join(future, ["snapshot", "customer_unique_id"], "left")
    return joined.withColumn("repeat", F.coalesce("_again", F.lit(0))).drop("_again")


def make_models(config: Config, rows: int) -> dict[str, Pipeline]:
    """Unfitted pipelines from raw features to a probability. `rows` is the size of the training set."""
    names = feature_names(config)

    def inputs(logged: tuple[str, ...]) -> SQLTransformer:
        exprs = []
        for c in names:
            value = f"coalesce(CAST({c} AS DOUBLE), 0D)"
            exprs.append((f"log1p(greatest({value}, 0D))" if c in logged else value) + f" AS x_{c}")
        return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")

    raw = [f"x_{c}" for c in names]
    linear = LogisticRegression(
        featuresCol="scaled", labelCol="repeat", maxIter=200, elasticNetParam=0.0, standardization=False,
        # the penalty is per row here, so that its weight against the summed loss is 1 / INVERSE_PENALTY
        regParam=1.0 / (INVERSE_PENALTY * max(rows, 1)),
    )
    trees = GBTClassifier(
        featuresCol="features", labelCol="repeat", maxIter=config.classifier_rounds, stepSize=config.gbt_step,
        maxDepth=4, minInstancesPerNode=50, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=config.seed,
    )
    return {
        LOGISTIC: Pipeline(stages=[
            inputs(SKEWED),
            VectorAssembler(inputCols=raw, outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            linear,
        ]),
        TREES: Pipeline(stages=[inputs(()), VectorAssembler(inputCols=raw, outputCol="features"), trees]),
    }


def with_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    kept = df.columns
    return model.transform(df).select(*kept, vector_to_array("probability")[1].alias("p_repeat"))


def binary_metrics(scored: DataFrame, label: str = "repeat", score: str = "p_repeat",
                   tie: str = "customer_unique_id", top: float = 0.1) -> DataFrame:
    """ROC-AUC, average precision, base rate, lift of the top share and Brier score, from exact ranks.

    Equal scores share a threshold in the first two; in the lift they are taken in the order of `tie`. Equal
    scores are counted before they are sorted, and the last row of the top share is found without a sort.
    Rows without a score come last.
    """
    rows = scored.select(
        F.coalesce(-F.col(score), F.lit(math.inf)).alias("v"), F.col(tie).alias("t"), F.col(label).cast("bigint").alias("y"),
    )
    rows = stage_table(rows, "judged")
    size = rows.count()
    first = max(1, math.floor(size * top))
    last = rows_at(rows.select("v", "t"), [first], size)[0] if size else Row(v=None, t=None)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    end = F.struct(F.lit(last["v"]).cast(kinds["v"]).alias("v"), F.lit(last["t"]).cast(kinds["t"]).alias("t"))
    counts = rows.groupBy("v").agg(
        F.count(F.lit(1)).alias("k"), F.sum("y").alias("kpos"),
        F.sum(F.when(F.struct("v", "t") <= end, F.col("y")).otherwise(0)).alias("top"),
    )
    run = with_running_totals(counts, [F.col("v")], {"k": "r", "kpos": "tp"})
    whole = run.agg(F.struct(F.sum("k").alias("n"), F.sum("kpos").alias("pos"))).scalar()
    by_score = run.withColumns({"_all": whole, "p": F.when(F.col("v") < math.inf, -F.col("v"))})
    n, pos, cut = F.col("_all.n"), F.col("_all.pos"), F.lit(first)
    neg = n - pos
    k_neg = F.col("k") - F.col("kpos")
    below = neg - (F.col("r") - F.col("tp"))
    won = F.col("kpos").cast("double") * (below + k_neg / 2)
    precise = F.col("kpos").cast("double") * F.col("tp") / F.col("r")
    squares = F.col("k") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("kpos") + F.col("kpos")
    return by_score.groupBy("_all").agg(
        F.sum(won).alias("won"), F.sum(precise).alias("precise"), F.sum(squares).alias("sq"), F.sum("top").alias("top")
    ).select(
        F.try_divide("won", pos.cast("double") * neg).alias("roc_auc"),
        F.try_divide("precise", pos.cast("double")).alias("pr_auc"),
        (pos / n).alias("base_rate"),
        (F.col("top") / cut / F.greatest(pos / n, F.lit(1e-9))).alias("lift_top10"),
        (F.col("sq") / n).alias("brier"),
    )


@dataclass(frozen=True)
class Trained:
    metrics: DataFrame  # one row per model, best first, with `selected` and `test_cutoff`
    models: dict[str, PipelineModel]
    best: str
    train: DataFrame
    test: DataFrame

    @property
    def model(self) -> PipelineModel:
        return self.models[self.best]


def train_and_evaluate(
    facts: DataFrame, items: DataFrame | None, config: Config, cutoff: Column | None = None
) -> Trained:
    """Fit both classifiers on the stacked training cutoffs and rank them by average precision on the test cutoff.

    Training and test sets come from one pass over the facts; `cutoff` defaults to `test_cutoff`.
    """
    if cutoff is None:
        cutoff = test_cutoff(facts, config)
    days = F.array(*train_cutoffs(cutoff, config), cutoff)
    sets = stage_table(labelled(facts, items, days, config), "labelled")
    last = sets.agg(F.max("snapshot")).scalar()
    train, test = sets.where(F.col("snapshot") < last), sets.where(F.col("snapshot") == last)
    def fit(job):
        name, pipeline = job
        model = pipeline.fit(train)
        scored = stage_table(with_probability(model, test), f"scored_{name}")
        return name, model, binary_metrics(scored).select(F.lit(name).alias("model"), "*")

    # the two fits are independent jobs
    done = in_parallel(sets.sparkSession, fit, make_models(config, train.count()).items(), 2)
    models = {name: model for name, model, _ in done}
    metrics = stage_table(done[0][2].unionByName(done[1][2]), "churn_metrics")
    best = metrics.orderBy(F.desc("pr_auc"), "model").first()["model"]
    metrics = metrics.withColumns({
        "selected": F.col("model") == best, "test_cutoff": last,
    }).orderBy(F.desc("pr_auc"), "model")
    return Trained(metrics, models, best, train, test)


def importance(model: PipelineModel, config: Config) -> DataFrame:
    """Absolute coefficients or normalised gain per feature, highest first."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, abs(float(v))) for n, v in zip(feature_names(config), weights.toArray(), strict=True)]
    df = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def with_risk_band(scored: DataFrame) -> DataFrame:
    """Five rank bins of p_repeat, the lowest named `very high`. Equal scores rank by customer id."""
    binned = quintile(scored, F.col("p_repeat"), "customer_unique_id", "_bin")
    names = F.array(*[F.lit(b) for b in RISK_BANDS])
    return binned.withColumn("risk_band", F.element_at(names, F.col("_bin").cast("int"))).drop("_bin")


def score_features(model: PipelineModel, feats: DataFrame, items: DataFrame | None, config: Config) -> DataFrame:
    """Repeat probability, churn risk and risk band per row of `customer_features` of one snapshot."""
    days = F.array(feats.agg(F.max("snapshot")).scalar())
    feats = with_state_flags(with_categories(feats, items, config, days), config)
    scored = with_probability(model, feats).select(
        "customer_unique_id", "customer_state", "recency_days", "frequency", "monetary", "avg_order_value",
        "p_repeat", (1 - F.col("p_repeat")).alias("churn_risk"),
    )
    # the scores are ranked and binned in separate reads
    return with_risk_band(stage_table(scored, "scored"))


def score_customers(model: PipelineModel, facts: DataFrame, items: DataFrame | None, config: Config,
                    snapshot: Column | None = None) -> DataFrame:
    """Score every customer of the facts at the snapshot (default: the day after the last order)."""
    days = None if snapshot is None else F.array(snapshot)
    return score_features(model, customer_features(facts, config, days), items, config)


# What a hypothetical customer has when nothing is given.
HYPOTHETICAL_DEFAULTS = {
    "avg_items": 1.0, "avg_freight": 20.0, "avg_review": 4.0, "avg_delivery_days": 12.0, "late_rate": 0.0,
    "avg_installments": 2.0, "credit_card_share": 1.0,
}
HYPOTHETICAL_STATE = "SP"
REPEAT_GAP_DAYS = 30


def hypothetical_features(df: DataFrame, config: Config) -> DataFrame:
    """Complete hypothetical customers: recency_days, frequency and monetary are required.

    Missing optional columns or values take defaults. `invalid` names the first input out of bounds, or is
    null; invalid rows keep null scores downstream.
    """
    optional = {**{k: "double" for k in HYPOTHETICAL_DEFAULTS}, "tenure_days": "bigint", "n_categories": "bigint",
                "customer_state": "string", "main_category": "string"}
    for name, kind in optional.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    bounds = {
        "recency_days": c("recency_days").isNull() | (c("recency_days") < 0),
        "frequency": c("frequency").isNull() | (c("frequency") < 1),
        "monetary": c("monetary").isNull() | (c("monetary") < 0),
        "tenure_days": c("tenure_days") < 0,
        "avg_review": ~c("avg_review").between(1, 5),
        "late_rate": ~c("late_rate").between(0, 1),
        "n_categories": c("n_categories") < 1,
        "credit_card_share": ~c("credit_card_share").between(0, 1),
    }
    df = df.withColumn("invalid", F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in bounds.items()]))
    guess = c("recency_days") + REPEAT_GAP_DAYS * (c("frequency") - 1)
    df = df.withColumns({
        **{k: F.coalesce(k, F.lit(v)) for k, v in HYPOTHETICAL_DEFAULTS.items()},
        "tenure_days": F.greatest(F.coalesce(c("tenure_days"), guess), c("recency_days")),
        "n_categories": F.coalesce(c("n_categories"), c("frequency")),
        "customer_state": F.coalesce(c("customer_state"), F.lit(HYPOTHETICAL_STATE)),
        "avg_order_value": F.try_divide(c("monetary").cast("double"), c("frequency")),
    })
    df = df.withColumns({
        "freight_ratio": F.coalesce(F.try_divide(c("avg_freight"), c("avg_order_value")), F.lit(0.0)),
        **{column_name("cat_", k): flag(c("main_category") == k).cast("bigint") for k in config.repeat_categories},
    })
    return with_state_flags(df, config)


def score_hypotheticals(model: PipelineModel, df: DataFrame, config: Config, name: str) -> DataFrame:
    """Scores of hypothetical customers; `name` labels the model used."""
    kept = df.columns
    scored = with_probability(model, hypothetical_features(df, config))
    p = F.when(F.col("invalid").isNull(), F.col("p_repeat"))
    return scored.select(*kept, "invalid", p.alias("p_repeat"), (1 - p).alias("churn_risk"),
                         F.lit(name).alias("model"))


def score_percentile(scored: DataFrame, p: float) -> DataFrame:
    """Share of customers whose repeat probability lies below `p`."""
    return scored.agg(F.avg(flag(F.col("p_repeat") < F.lit(p))).alias("percentile"))
