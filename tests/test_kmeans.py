from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallymart.operators import kmeans
from tallymart.operators.kmeans import Run
from tallymart.session import in_parallel


def blobs(n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 4)) + rng.integers(0, 4, size=(n, 1)) * 3


@pytest.fixture(scope="module")
def points(spark):
    df = spark.createDataFrame([(x.tolist(),) for x in blobs(1500)], "x array<double>").repartition(5).persist()
    df.count()
    return df


def plain_lloyd(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, float]:
    while True:
        far = ((x[:, None] - centers[None]) ** 2).sum(2)
        near = far.argmin(1)
        moved = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
        if ((moved - centers) ** 2).sum() <= kmeans.TOLERANCE:
            return centers, far.min(1).sum()
        centers = moved


def plain_silhouette(x: np.ndarray, near: np.ndarray, power: int) -> float:
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    far = far if power == 2 else np.sqrt(far)
    out = []
    for i in range(len(x)):
        means = {c: far[i, near == c].sum() / max((near == c).sum() - (c == near[i]), 1) for c in set(near.tolist())}
        own = means.pop(near[i])
        alone = (near == near[i]).sum() == 1
        other = min(means.values(), default=np.nan)
        out.append(0.0 if alone or not means else (other - own) / max(own, other))
    return float(np.mean(out))


def test_joint_runs_equal_separate_ones(points):
    x = np.array([r["x"] for r in points.collect()])
    starts = {Run(k, i): x[np.random.default_rng(10 * k + i).choice(len(x), k, replace=False)] for k in (2, 3, 5) for i in range(3)}
    fitted = kmeans.fit_all(points, "x", starts)
    assert fitted.keys() == starts.keys() and len({f.iterations for f in fitted.values()}) > 1
    for run, start in starts.items():
        centers, cost = plain_lloyd(x, start)
        assert fitted[run].cost == pytest.approx(cost, rel=1e-6)
        assert np.abs(fitted[run].centers - centers).max() < 1e-6
        alone = kmeans.fit_all(points, "x", {run: start})[run]
        assert alone.cost == pytest.approx(fitted[run].cost, rel=1e-9)


def test_one_read_per_iteration(points, monkeypatch):
    reads, original = [], kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda *a: reads.append(len(a[2])) or original(*a))
    x = blobs(1500)
    starts = {Run(k, i): kmeans.spread_start(x, k, i) for k in (2, 3, 4) for i in range(4)}
    fitted = kmeans.fit_all(points, "x", starts)
    assert len(reads) == max(f.iterations for f in fitted.values()) + 1
    assert reads[0] == 12 and reads == sorted(reads, reverse=True)


def test_no_worse_than_the_library(points):
    x = blobs(1500)
    starts = {Run(4, i): kmeans.spread_start(x, 4, i) for i in range(5)}
    ours = kmeans.best_runs(kmeans.fit_all(points, "x", starts))[4].cost
    vectors = points.select(array_to_vector("x").alias("features")).persist()
    theirs = min(KMeans(k=4, seed=i, maxIter=300).fit(vectors).summary.trainingCost for i in range(3))
    assert ours <= theirs * 1.001


@pytest.mark.parametrize("k", [1, 2, 5])
def test_silhouettes(spark, points, k):
    few = points.limit(500).persist()
    x = np.array([r["x"] for r in few.collect()])
    centers = kmeans.spread_start(x, k, 1)
    near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    squared = kmeans.squared_silhouettes(few, "x", {k: centers})[k]
    assert squared == pytest.approx(plain_silhouette(x, near, 2), abs=1e-9)
    assert kmeans.plain_silhouettes(few, "x", {k: centers}, 1)[k] == pytest.approx(plain_silhouette(x, near, 1), abs=1e-9)
    if k > 1:
        rows = [(v.tolist(), int(c)) for v, c in zip(x, near, strict=True)]
        labelled = spark.createDataFrame(rows, "x array<double>, prediction int").select(array_to_vector("x").alias("features"), "prediction")
        assert squared == pytest.approx(ClusteringEvaluator().evaluate(labelled), abs=1e-9)


def test_equal_points_and_empty_tables(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 20, "x array<double>")
    start = kmeans.spread_start(kmeans.sample_points(same, "x", 1), 3, 1)
    assert kmeans.fit_all(same, "x", {Run(3, 0): start})[Run(3, 0)].cost == 0
    assert kmeans.squared_silhouettes(same, "x", {3: start}) == kmeans.plain_silhouettes(same, "x", {3: start}, 1) == {3: 0.0}
    assert kmeans.fit_all(same.limit(0), "x", {Run(3, 0): start})[Run(3, 0)].cost == 0


def test_the_sample_does_not_depend_on_partitions(points):
    few = kmeans.sample_points(points, "x", 7, 50)
    assert few.shape == (50, 4) and (few == kmeans.sample_points(points.repartition(2, F.rand()), "x", 7, 50)).all()


def test_concurrent_jobs_have_properties_of_their_own(spark):
    import threading

    together = threading.Barrier(3)
    system = spark.sparkContext._jvm.java.lang.System

    def number(_):
        together.wait(30)
        return system.identityHashCode(spark.sparkContext._jsc.sc().getLocalProperties())

    assert len(set(in_parallel(spark, number, range(3), 3))) == 3
