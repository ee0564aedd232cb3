"""One boosted-tree model over all demand series, applied recursively."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.operators.calendar import calendar_features
from tallymart.operators.demand import CALENDAR, FEATURES, LAGS, MEANS, supervised
from tallymart.operators.forecasting import BOOSTED, histories
from tallymart.session import in_parallel, stage_table

# Trees take no nulls. Logged demand is never negative, so this is a value of its own for a missing lag.
MISSING = -1.0
TAIL = max(LAGS)


def fit(panel: DataFrame, config: Config, features: DataFrame | None = None) -> PipelineModel:
    """Fit on the rows with a known fourth lag; the target is log(1 + y).

    The panel has one row per series and week, so the training set is small at any data volume.
    """
    df = supervised(panel) if features is None else features
    names = [r["series"] for r in df.select("series", "series_code").distinct().orderBy("series_code").collect()]
    df = df.where(F.col("lag_4").isNotNull()).fillna(MISSING, list(FEATURES[:-1])).withColumn(
        "series_code", F.col("series_code").cast("double").alias("series_code", metadata=nominal(names))
    )
    trees = GBTRegressor(
        featuresCol="features", labelCol="ly", predictionCol="predicted", maxIter=config.gbt_rounds,
        stepSize=config.gbt_step, maxDepth=config.gbt_depth, minInstancesPerNode=10, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", seed=config.seed, maxBins=max(64, len(names)),
    )
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return Pipeline(stages=[assembler, trees]).fit(df.select("ly", *FEATURES))


def nominal(names: Sequence[str]) -> dict:
    """Column metadata that makes trees treat codes as names without an order."""
    return {"ml_attr": {"type": "nominal", "name": "series_code", "vals": list(names)}}


def _step_features(tail: str) -> dict[str, str]:
    """SQL of the features of the next week from `tail`, the last logged values with the newest last."""
    def total(values: str) -> str:
        return f"aggregate({values}, 0D, (a, v) -> a + v)"

    def mean(k: int) -> str:
        return f"({total(f'slice({tail}, -{k}, {k})')} / {k})"

    def known(k: int, value: str) -> str:
        return f"CASE WHEN size({tail}) >= {k} THEN {value} ELSE {MISSING}D END"

    squares = total(f"transform(slice({tail}, -4, 4), v -> (v - {mean(4)}) * (v - {mean(4)}))")
    return {
        **{f"lag_{k}": known(k, f"element_at({tail}, -{k})") for k in LAGS},
        **{f"roll_mean_{k}": known(k, mean(k)) for k in MEANS},
        "roll_std_4": known(4, f"sqrt({squares} / 3)"),
    }


class Node(NamedTuple):
    """A place in a tree. A leaf has no children (0); places count from 1. `names` are the codes that go left."""

    feature: int
    threshold: float
    names: list[float] | None
    left: int
    right: int
    value: float


NODES = (
    "array<struct<weight:double,nodes:array<struct<feature:int,threshold:double,names:array<double>,left:int,right:int,value:double>>>>"
)


def compiled(model: PipelineModel) -> list[tuple[float, list[Node]]]:
    """The fitted ensemble as (weight, nodes) of each tree, read from the model's own description."""
    trees, weights = [], model.stages[-1].treeWeights
    lines: list[str] = []
    for line in model.stages[-1].toDebugString.splitlines():
        if re.match(r" *Tree \d+", line):
            lines = []
            trees.append(lines)
        elif line.strip():
            lines.append(line.strip())
    return [(w, _nodes(t)) for w, t in zip(weights, trees[:len(weights)], strict=True)]


def _nodes(lines: list[str]) -> list[Node]:
    nodes: list[Node | None] = []
    rest = iter(lines)

    def place() -> int:
        line = next(rest)
        nodes.append(None)
        at = len(nodes)
        leaf = re.match(r"Predict: (\S+)$", line)
        if leaf:
            nodes[at - 1] = Node(0, 0.0, None, 0, 0, float(leaf[1]))
            return at
        test = re.match(r"If \(feature (\d+) (?:<= (\S+)|in \{(.*)\})\)$", line)
        left = place()
        next(rest)  # the opposite test
        right = place()
        names = None if test[3] is None else [float(v) for v in test[3].split(",")]
        nodes[at - 1] = Node(int(test[1]), float(test[2] or 0), names, left, right, 0.0)
        return at

    place()
    return nodes


def walked(features: str, depth: int) -> str:
    """SQL of the ensemble's value for an array of features; the trees are the column `_trees`."""
    here = "element_at(t.nodes, i)"
    goes_left = (
        f"CASE WHEN {here}.names IS NULL THEN {features}[{here}.feature] <= {here}.threshold "
        f"ELSE array_contains({here}.names, {features}[{here}.feature]) END"
    )
    leaf = f"aggregate(sequence(1, {depth}), 1, (i, _) -> CASE WHEN {here}.left = 0 THEN i WHEN {goes_left} THEN {here}.left ELSE {here}.right END)"
    return f"aggregate(_trees, 0D, (total, t) -> total + t.weight * element_at(t.nodes, {leaf}).value)"


def predict(model: PipelineModel, hist: DataFrame, horizon: int, holidays: DataFrame | None = None) -> DataFrame:
    """Forecast week after week, each prediction becoming history for the next.

    `hist` holds one row per series (and fold). The ensemble is an array of trees, each an array of nodes, and the weeks
    are folded over in one expression, so the plan is one projection over these rows at any horizon.
    """
    logged = F.transform(F.slice("ys", F.greatest(F.size("ys") - TAIL + 1, F.lit(1)), TAIL), lambda y: F.log1p(y))
    state = hist.select("fold", "cutoff", "series", F.col("series_code").cast("double").alias("series_code"), logged.alias("tail"))
    ahead = hist.select("cutoff").distinct().select(
        "cutoff", F.explode(F.sequence(F.date_add("cutoff", 7), F.date_add("cutoff", 7 * horizon),
                                       F.expr("interval 7 days"))).alias("week")
    )
    days = ahead.select("week").distinct()
    calendar = ahead.join(calendar_features(days, holidays), "week").groupBy("cutoff").agg(
        F.sort_array(F.collect_list(F.struct("week", *CALENDAR))).alias("calendar")
    )
    state = stage_table(state.join(calendar, "cutoff"), "boosted_state")
    trees = [{"weight": w, "nodes": [n._asdict() for n in nodes]} for w, nodes in compiled(model)]
    values = {**_step_features("s.tail"), **{c: f"day.{c}" for c in CALENDAR}, "series_code": "series_code"}
    features = ", ".join(f"CAST({values[c]} AS DOUBLE)" for c in FEATURES)
    depth = max(1, model.stages[-1].getMaxDepth())
    forecast = F.expr(f"""
        aggregate(calendar, named_struct('tail', tail, 'yhats', CAST(array() AS ARRAY<DOUBLE>)), (s, day) -> element_at(
            transform(
                transform(array(array({features})), x -> greatest(expm1({walked("x", depth)}), 0D)),
                y -> named_struct('tail', concat(s.tail, array(log1p(y))), 'yhats', concat(s.yhats, array(y)))
            ), 1), s -> s.yhats)""")
    # the trees are a constant of the plan
    made = state.withColumn("_trees", F.from_json(F.lit(json.dumps(trees)), NODES)).withColumn("yhats", forecast)
    out = made.select("fold", "cutoff", "series", F.posexplode("yhats").alias("_at", "yhat"))
    h = F.col("_at") + 1
    return out.select(
        "fold", "cutoff", "series", F.lit(BOOSTED).alias("model"), h.alias("h"),
        F.date_add("cutoff", h * 7).alias("week"), "yhat",
    )


def boosted_forecasts(panel: DataFrame, horizon: int, folds: Sequence[int], config: Config | None = None,
                      holidays: DataFrame | None = None, models: dict[int, PipelineModel] | None = None) -> DataFrame:
    """Forecasts per fold from a model fitted on that fold's history alone. The folds are fitted concurrently.

    The fitted models are put into `models` when it is given, by fold.
    """
    config = config or Config()
    feats = stage_table(supervised(panel, holidays), "supervised")
    codes = feats.select("series", F.col("series_code").cast("double").alias("series_code")).distinct()
    hist = stage_table(histories(panel, horizon, folds).join(codes, "series"), "histories")
    cutoffs = {r["fold"]: r["cutoff"] for r in hist.select("fold", "cutoff").distinct().collect()}

    def one(fold: int) -> DataFrame:
        known = feats.where(F.col("week") <= F.lit(cutoffs[fold]))
        model = fit(panel, config, known)
        if models is not None:
            models[fold] = model
        return stage_table(predict(model, hist.where(F.col("fold") == fold), horizon, holidays), f"boosted_{fold}")

    parts = in_parallel(panel.sparkSession, one, sorted(cutoffs), 4)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(model: PipelineModel) -> DataFrame:
    """Normalised gain per feature, highest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(FEATURES, weights, strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, gain double").orderBy(
        F.desc("gain"), "feature"
    )
