"""Fitted models as tables, and scores computed from such tables.

A model table has one row per feature, centre and feature, or tree node, so its size is set by the model and not by
the data. A scorer folds it to one array in a scalar subquery; every row to be scored walks that array in one
projection, without a join or a shuffle. Stored with any sink, a table scores without the library that fitted it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators.boosted import compiled, walked

LINEAR = "position int, feature string, mean double, deviation double, coefficient double, intercept double"
CENTERS = "cluster int, position int, feature string, mean double, deviation double, center double"
TREES = ("tree int, weight double, node int, feature int, threshold double, names array<double>, `left` int, "
         "`right` int, value double")


def linear_table(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """A fitted (assembler, scaler, logistic regression) pipeline: one row per input, the intercept in each."""
    scaler, last = model.stages[-2], model.stages[-1]
    columns = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), last.coefficients.toArray().tolist()
    rows = [
        (i, name, mean, deviation, weight, float(last.intercept))
        for i, (name, mean, deviation, weight) in enumerate(zip(names, *columns, strict=True), 1)
    ]
    return spark.createDataFrame(rows, LINEAR)


def center_table(spark: SparkSession, centers, mean, deviation, names) -> DataFrame:
    """Cluster centres in scaled space with the scale of each input: one row per cluster and input."""
    rows = [
        (k, i + 1, name, float(mean[i]), float(deviation[i]), float(center[i]))
        for k, center in enumerate(centers) for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, CENTERS)


def tree_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """A fitted boosted ensemble: one row per tree node. Nodes count from 1; a leaf has no children (0)."""
    rows = [
        (t, weight, at, *node) for t, (weight, nodes) in enumerate(compiled(model), 1) for at, node in enumerate(nodes, 1)
    ]
    return spark.createDataFrame(rows, TREES)


def _scaled(x: Column, row: Column) -> Column:
    """An input that never varies is scaled to 0."""
    return F.when(row["deviation"] == 0, 0.0).otherwise((x - row["mean"]) / row["deviation"])


def _folded(table: DataFrame, *columns: str) -> Column:
    return table.agg(F.sort_array(F.collect_list(F.struct(*columns)))).scalar()


def linear_probability(df: DataFrame, table: DataFrame, inputs: Column, out: str = "p_repeat") -> DataFrame:
    """Add the logistic probability of the array `inputs`, whose order is that of `position`."""
    model = _folded(table, "position", "mean", "deviation", "coefficient", "intercept")
    margin = F.aggregate(
        "_model", F.get("_model", F.lit(0))["intercept"],
        lambda a, m: a + m["coefficient"] * _scaled(F.element_at("_x", m["position"]), m),
    )
    made = df.withColumns({"_model": model, "_x": inputs}).withColumn(out, 1 / (1 + F.exp(-margin)))
    return made.drop("_model", "_x")


def tree_probability(df: DataFrame, table: DataFrame, inputs: Column, depth: int, out: str = "p_repeat") -> DataFrame:
    """Add the probability of class 1 by boosted trees of logistic loss, on the array `inputs`."""
    trees = table.groupBy("tree").agg(
        F.first("weight").alias("weight"),
        F.sort_array(F.collect_list(F.struct("node", "feature", "threshold", "names", "left", "right", "value"))).alias("nodes"),
    )
    made = df.withColumns({"_trees": _folded(trees, "tree", "weight", "nodes"), "_x": inputs})
    # the loss is log(1 + exp(-2 y f)), so the odds are exp(2 f)
    return made.withColumn(out, 1 / (1 + F.exp(-2 * F.expr(walked("_x", depth))))).drop("_trees", "_x")


def nearest_center(df: DataFrame, table: DataFrame, inputs: Column, out: str = "cluster") -> DataFrame:
    """Add the cluster whose centre is nearest to the array `inputs`; the smallest number wins ties."""
    each = F.sort_array(F.collect_list(F.struct("position", "mean", "deviation", "center"))).alias("at")
    centers = _folded(table.groupBy("cluster").agg(each), "cluster", "at")

    def away(c: Column) -> Column:
        square = F.aggregate(c["at"], F.lit(0.0), lambda a, m: a + F.pow(
            _scaled(F.element_at("_x", m["position"]), m) - m["center"], F.lit(2.0)))
        return F.struct(square.alias("away"), c["cluster"].alias("cluster"))

    made = df.withColumns({"_centers": centers, "_x": inputs})
    return made.withColumn(out, F.array_min(F.transform("_centers", away))["cluster"]).drop("_centers", "_x")
