from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallymart.operators import model_tables

NAMES = ["a", "b", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [(i, rng.gauss(3, 2), rng.choice([0.0, 1.0, 1.0, 5.0]), 4.0) for i in range(400)]
    return spark.createDataFrame(
        [(*r, int(r[1] + r[2] + rng.gauss(0, 1) > 4.5)) for r in made],
        "id long, a double, b double, same double, repeat int").persist()


def stored(table, folder):
    """A table scores the same once it was written."""
    table.write.parquet(str(folder))
    return table.sparkSession.read.parquet(str(folder))


def differences(model, rows, scored):
    fitted = model.transform(rows).select("id", vector_to_array("probability")[1].alias("fitted"))
    return scored.join(fitted, "id").select(F.max(F.abs(F.col("p_repeat") - F.col("fitted"))), F.count("*")).first()


def test_logistic_table_scores_as_the_fitted_pipeline(spark, rows, tmp_path):
    model = Pipeline(stages=[
        VectorAssembler(inputCols=NAMES, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="repeat", regParam=0.01),
    ]).fit(rows)
    table = stored(model_tables.linear_table(spark, model, NAMES), tmp_path / "linear")
    assert [r["feature"] for r in table.orderBy("position").collect()] == NAMES
    scored = model_tables.linear_probability(rows, table, F.array(*NAMES))
    assert scored.columns == [*rows.columns, "p_repeat"]
    worst, n = differences(model, rows, scored)
    assert n == 400 and worst < 1e-9
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]


def test_tree_table_scores_as_the_fitted_pipeline(spark, rows, tmp_path):
    model = Pipeline(stages=[
        VectorAssembler(inputCols=NAMES, outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol="repeat", maxIter=7, maxDepth=3, seed=1),
    ]).fit(rows)
    table = stored(model_tables.tree_table(spark, model), tmp_path / "trees")
    assert table.select("tree").distinct().count() == 7
    # every node but the first of a tree is the child of one other
    children = table.where("`left` > 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    assert children.exceptAll(table.where("node > 1").select("tree", "node")).count() == 0
    worst, n = differences(model, rows, model_tables.tree_probability(rows, table, F.array(*NAMES), 3))
    assert n == 400 and worst < 1e-9


def test_nearest_center_by_hand(spark, rows):
    mean, deviation = np.array([3.0, 1.0, 4.0]), np.array([2.0, 0.5, 0.0])
    centers = np.array([[1.0, 0.0, 0.0], [-1.0, 2.0, 0.0], [1.0, 0.0, 0.0], [0.0, 8.0, 0.0]])  # the third ties the first
    table = model_tables.center_table(spark, centers, mean, deviation, NAMES)
    got = {r["id"]: r["cluster"] for r in model_tables.nearest_center(rows, table, F.array(*NAMES)).collect()}
    for r in rows.collect():
        z = [(r["a"] - 3) / 2, (r["b"] - 1) / 0.5, 0.0]
        away = [math.dist(z, c) for c in centers]
        assert away[got[r["id"]]] == pytest.approx(min(away)) and got[r["id"]] != 2


def test_no_rows(spark, rows):
    table = model_tables.center_table(spark, [[0.0]], [0.0], [1.0], ["a"])
    assert model_tables.nearest_center(rows.limit(0), table, F.array("a")).collect() == []
