"""K-Means for many numbers of clusters and restarts at once, and the scores that choose between them.

All runs advance together: one iteration reads the points once, adds up the points nearest to each centre of each run
inside the tasks, and sums one row per (run, cluster) and task. Runs whose centres stand still drop out. Starting
centres come from a bounded sample of the points, so few iterations over all points are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The plain Euclidean silhouette, and the starting centres, are worked out on at most so many points.
SAMPLE, START_SAMPLE = 10_000, 2_000
#: A run ends when the squares of its centres' moves, over all coordinates, add up to the tolerance or less.
MAX_ITERATIONS, TOLERANCE = 300, 1e-4


class Run(NamedTuple):
    k: int
    restart: int


class Fitted(NamedTuple):
    centers: np.ndarray  # k x dimensions
    cost: float  # sum of squared distances to the nearest centre
    iterations: int


def sample_points(points: DataFrame, column: str, seed: int, size: int = SAMPLE) -> np.ndarray:
    """At most `size` points, the same ones however the rows are partitioned: those of least seeded hash of the point."""
    order = F.xxhash64(F.col(column), F.lit(seed))
    rows = points.select(column, order.alias("_order")).orderBy("_order", column).limit(size).collect()
    return np.array([r[column] for r in rows], float)


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres."""
    far = (points * points).sum(1)[:, None] - 2 * points @ centers.T + (centers * centers).sum(1)
    return np.maximum(far, 0)


def spread_start(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting points, each drawn in proportion to its squared distance from those before, then settled on `points`."""
    rng = np.random.default_rng(seed)
    centers = points[rng.integers(len(points))][None]
    while len(centers) < k:
        far = _squares(points, centers).min(1)
        weights = far / far.sum() if far.sum() > 0 else None
        centers = np.vstack([centers, points[rng.choice(len(points), p=weights)]])
    for _ in range(MAX_ITERATIONS):
        near = _squares(points, centers).argmin(1)
        chosen = (near == np.arange(k)[:, None]).astype(float)
        many = chosen.sum(1)[:, None]
        moved = np.where(many > 0, chosen @ points / np.maximum(many, 1), centers)
        if ((moved - centers) ** 2).sum() <= TOLERANCE:
            break
        centers = moved
    return centers


def _points(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(points: DataFrame, column: str, centers: dict[Run, np.ndarray], rows_of: Callable) -> dict[Run, np.ndarray]:
    """Per run the sum over all points of `rows_of(points, centers)`, an array with a row per cluster; one read."""
    runs = list(centers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [None] * len(runs)
        for batch in batches:
            if batch.num_rows:
                x = _points(batch)
                for i, run in enumerate(runs):
                    rows = rows_of(x, centers[run], run)
                    total[i] = rows if total[i] is None else total[i] + rows
        out = [(i, c, row.tolist()) for i, rows in enumerate(total) if rows is not None for c, row in enumerate(rows)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)],
                ["run", "cluster", "sums"],
            )

    parts = points.select(column).mapInArrow(work, "run int, cluster int, sums array<double>")
    width = len(next(iter(centers.values()))[0]) + 3
    # one row per (run, cluster); tasks are added in a fixed order, so results repeat to the last digit
    added = parts.groupBy("run", "cluster").agg(F.sort_array(F.collect_list("sums")).alias("all")).select(
        "run", "cluster", F.aggregate(
            "all", F.array_repeat(F.lit(0.0), width), lambda a, x: F.zip_with(a, x, lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))
        ).alias("sums"),
    )
    out: dict[Run, np.ndarray] = {run: np.zeros((run.k, width)) for run in runs}
    for row in added.collect():
        out[runs[row["run"]]][row["cluster"]] = row["sums"]
    return out


def _assign(x: np.ndarray, centers: np.ndarray, run: Run) -> np.ndarray:
    """Per cluster: sums of its points, how many there are, their cost, and their sum of squares."""
    far = _squares(x, centers)
    near = far.argmin(1)
    chosen = np.zeros((len(centers), len(x)))
    chosen[near, np.arange(len(x))] = 1
    return np.hstack([chosen @ x, chosen.sum(1)[:, None], (chosen @ far.min(1))[:, None], (chosen @ (x * x).sum(1))[:, None]])


def fit_all(points: DataFrame, column: str, starts: dict[Run, np.ndarray], max_iterations: int = MAX_ITERATIONS) -> dict[Run, Fitted]:
    """Lloyd iterations from `starts` over all `points`, every run in the same reads, until its centres stand still.

    `column` holds arrays of double without nulls. A cluster that loses all points keeps its centre. An empty table
    returns the starts with a cost of 0.
    """
    active, done = dict(starts), {}
    for step in range(max_iterations + 1):
        for run, sums in _sums(points, column, active, _assign).items():
            centers, many = active[run], sums[:, -3]
            moved = np.where(many[:, None] > 0, sums[:, :-3] / np.maximum(many, 1)[:, None], centers)
            if step == max_iterations or ((moved - centers) ** 2).sum() <= TOLERANCE:
                done[run] = Fitted(centers, float(sums[:, -2].sum()), step)
                del active[run]
            else:
                active[run] = moved
        if not active:
            break
    return done


def best_runs(fitted: dict[Run, Fitted]) -> dict[int, Fitted]:
    """Per k the run of least cost; the first restart wins ties."""
    best: dict[int, Fitted] = {}
    for run in sorted(fitted):
        if run.k not in best or fitted[run].cost < best[run.k].cost:
            best[run.k] = fitted[run]
    return best


def squared_silhouettes(points: DataFrame, column: str, centers: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette under squared distances over all points, for each k: two reads for all of them.

    The mean squared distance to a cluster follows from its count, sum and sum of squares. A point alone in its cluster
    counts 0.
    """
    runs = {Run(k, 0): c for k, c in centers.items()}
    known = _sums(points, column, runs, _assign)

    def score(x: np.ndarray, centers: np.ndarray, run: Run) -> np.ndarray:
        sums = known[run]
        many = sums[:, -3]
        full = np.maximum(many, 1)
        near = _squares(x, centers).argmin(1)
        mean = (x * x).sum(1)[:, None] + sums[:, -1] / full - 2 * x @ (sums[:, :-3] / full[:, None]).T
        rows = np.arange(len(x))
        own = mean[rows, near] * many[near] / np.maximum(many[near] - 1, 1)
        other = np.where(many > 0, mean, np.inf)
        other[rows, near] = np.inf
        return _add_silhouettes(own, other.min(1), many[near], near, len(centers), x.shape[1])

    return {run.k: _mean_silhouette(sums) for run, sums in _sums(points, column, runs, score).items()}


def _add_silhouettes(own, other, many, near, k: int, dimensions: int) -> np.ndarray:
    most = np.maximum(own, other)
    value = np.where((many > 1) & np.isfinite(other) & (most > 0), (other - own) / np.where(most > 0, most, 1), 0.0)
    out = np.zeros((k, dimensions + 3))
    np.add.at(out, (near, -2), np.nan_to_num(value))
    np.add.at(out, (near, -3), 1)
    return out


def _mean_silhouette(sums: np.ndarray) -> float:
    return float(sums[:, -2].sum() / max(sums[:, -3].sum(), 1))


def plain_silhouettes(points: DataFrame, column: str, centers: dict[int, np.ndarray], seed: int, size: int = SAMPLE) -> dict[int, float]:
    """Mean silhouette under plain distances on a sample of at most `size` points, for each k.

    The sample is a broadcast of bounded size; its blocks are dealt to the tasks, and each meets the whole sample block
    by block.
    """
    spark = points.sparkSession
    every = sample_points(points, column, seed, size)
    if not len(every):
        return dict.fromkeys(centers, 0.0)
    sample = spark.sparkContext.broadcast(every)
    labels = {k: _squares(every, c).argmin(1) for k, c in centers.items()}
    block = 500

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sample.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                rows = np.arange(at, min(at + block, len(x)))
                sums = {k: np.zeros((len(rows), len(c))) for k, c in centers.items()}
                for begin in range(0, len(x), block):
                    part = x[begin:begin + block]
                    far = np.sqrt(((x[rows][:, None, :] - part[None]) ** 2).sum(2))
                    for k in centers:
                        chosen = np.zeros((len(part), len(centers[k])))
                        chosen[np.arange(len(part)), labels[k][begin:begin + block]] = 1
                        sums[k] += far @ chosen
                for k, c in centers.items():
                    many, near, i = np.bincount(labels[k], minlength=len(c)), labels[k][rows], np.arange(len(rows))
                    own = sums[k][i, near] / np.maximum(many[near] - 1, 1)
                    other = np.where(many > 0, sums[k] / np.maximum(many, 1), np.inf)
                    other[i, near] = np.inf
                    value = _add_silhouettes(own, other.min(1), many[near], near, len(c), 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([float(value[:, -2].sum())])], ["k", "at", "value"]
                    )

    blocks = spark.range(0, len(every), block, numPartitions=max(1, min(spark.sparkContext.defaultParallelism, -(-len(every) // block))))
    scored = blocks.mapInArrow(work, "k int, at long, value double").groupBy("k").agg(
        F.aggregate(F.sort_array(F.collect_list(F.struct("at", "value"))), F.lit(0.0), lambda a, v: a + v["value"]).alias("value")
    )
    return {r["k"]: r["value"] / len(every) for r in scored.collect()}
