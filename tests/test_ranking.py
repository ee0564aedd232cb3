from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction
from math import ceil
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallymart.operators import clv, propensity, ranking


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 11, 1503])
@pytest.mark.parametrize("descending", [False, True])
def test_quintile_is_the_rank_cut(spark, n, descending):
    rng = random.Random(n)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(40)])) for i in range(n)]  # one value is very common
    df = ranking.quintile(spark.createDataFrame(rows, "id long, v long"), F.col("v"), "id", "q", descending)
    got = {r["id"]: r["q"] for r in df.collect()}
    order = sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0]))
    want = {r[0]: max(1, ceil(Fraction(5 * i, max(n - 1, 1)))) for i, r in enumerate(order)}
    assert got == want


def _bins(spark, rows, schema, cuts, descending=False):
    df = ranking.with_rank_bin(spark.createDataFrame(rows, schema).repartition(7), F.col("v"), "id", cuts, "b", descending)
    return {r["id"]: r["b"] for r in df.collect()}


def _wanted(ids, cuts):
    n = len(ids)
    ends = [(n - 1) * q.numerator // q.denominator + 1 for q in cuts]
    return {i: 1 + sum(r > e for e in ends) for r, i in enumerate(ids, 1)}


CUTS = [Fraction(1, 100), Fraction(1, 3), Fraction(1, 2), Fraction(1, 2), Fraction(19, 20)]


@pytest.mark.parametrize("in_one_task", [0, 1, 1_000_000])
def test_cuts_inside_one_value_that_most_rows_have(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(ranking, "ROWS_IN_ONE_TASK", in_one_task)
    rng = random.Random(5)
    rows = [(f"{rng.choice(['same-head-', '\u00e9', ''])}{i * 7919 % 6007}", rng.choice([1.5, 1.5, 1.5, rng.random()]))
            for i in range(6007)]
    want = sorted(rows, key=lambda r: (r[1], r[0].encode()))
    assert _bins(spark, rows, "id string, v double", CUTS) == _wanted([r[0] for r in want], CUTS)


@pytest.mark.parametrize("in_one_task", [0, 500, 1_000_000])
def test_cuts_order_nulls_first_and_nan_last(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(ranking, "ROWS_IN_ONE_TASK", in_one_task)
    rng = random.Random(6)
    rows = [(i, rng.choice([None, None, float("nan"), float("-inf"), 0.0, -0.0, rng.random()])) for i in range(900)]

    def place(r):
        return (0, 0, r[0]) if r[1] is None else (2, 0, r[0]) if r[1] != r[1] else (1, r[1], r[0])

    want = [r[0] for r in sorted(rows, key=place)]
    assert _bins(spark, rows, "id long, v double", CUTS) == _wanted(want, CUTS)


def test_cuts_of_decimals_that_one_double_stands_for(spark):
    rows = [(i, Decimal(10**20 + i * 7 % 50)) for i in range(300)]
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert _bins(spark, rows, "id long, v decimal(22,0)", CUTS, descending=True) == _wanted(want, CUTS)


@pytest.mark.parametrize("in_one_task", [0, 1_000_000])
def test_a_sketch_that_misses_changes_no_bin(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(ranking, "ROWS_IN_ONE_TASK", in_one_task)
    monkeypatch.setattr(ranking, "_brackets", lambda *a: [(3.0, 4.0), (90.0, 91.0)])
    rows = [(i, i % 97) for i in range(500)]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert _bins(spark, rows, "id long, v long", CUTS) == _wanted(want, CUTS)


@pytest.mark.parametrize("in_one_task", [1, 1_000_000])
def test_only_the_brackets_are_sorted(spark, monkeypatch, in_one_task):
    sizes, numbered, totals = [], ranking._numbered, ranking.with_running_totals
    monkeypatch.setattr(ranking, "_numbered", lambda df, *a: sizes.append(df.count()) or numbered(df, *a))
    monkeypatch.setattr(ranking, "with_running_totals", lambda df, *a: sizes.append(df.count()) or totals(df, *a))
    monkeypatch.setattr(ranking, "with_rank", None)
    monkeypatch.setattr(ranking, "ROWS_IN_ONE_TASK", in_one_task)
    df = spark.range(300_000).selectExpr("id", "hash(id) AS v")
    got = ranking.with_rank_bin(df, F.col("v"), "id", [Fraction(i, 5) for i in range(1, 5)], "b")
    assert [r["count"] for r in got.groupBy("b").count().orderBy("b").collect()] == [60_000] * 5
    assert sizes and sum(sizes) < 3_000
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_no_rows_have_no_cuts(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert ranking.with_rank_bin(empty, F.col("v"), "id", CUTS, "b").collect() == []


def test_seven_values_differ_from_equal_tiles(spark):
    df = ranking.quintile(spark.range(7), F.col("id"), "id", "q")
    assert [r["q"] for r in df.orderBy("id").collect()] == [1, 1, 2, 3, 4, 5, 5]


def test_rank_and_running_totals(spark):
    df = spark.range(500).selectExpr("id", "id * 37 % 11 AS v", "id % 5 AS w").repartition(6)
    ranked = ranking.with_rank(df, [F.desc("v"), F.col("id")])
    rows = sorted((r["id"], r["v"]) for r in df.collect())
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want
    run = ranking.with_running_totals(df, [F.col("v"), F.col("id")], {"w": "upto"})
    total, expected = 0, {}
    for r in sorted(df.collect(), key=lambda r: (r["v"], r["id"])):
        total += r["w"]
        expected[r["id"]] = total
    assert {r["id"]: r["upto"] for r in run.collect()} == expected


def test_medians_per_group(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.0, 2.5, rng.random()]), float(i)) for g in "abc" for i in range(41)]
    rows.append(("d", None, 1.0))
    got = {r["g"]: (r["x"], r["y"]) for r in ranking.medians(
        spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"]).collect()}
    for g in "abc":
        xs = [x for k, x, _ in rows if k == g and x is not None]
        assert got[g] == (median(xs), 20.0)
    assert got["d"] == (None, 1.0)


def test_value_tiers(spark):
    assert [float(c) for c in clv.TIER_CUTS] == [0.5, 0.8, 0.95]
    df = ranking.with_rank_bin(spark.range(101), F.col("id"), "id", clv.TIER_CUTS, "b")
    sizes = {r["b"]: r["count"] for r in df.groupBy("b").count().collect()}
    assert sizes == {1: 51, 2: 30, 3: 15, 4: 5}


def test_binary_metrics_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), rng.choice([0.1, 0.2, 0.4, 0.8])) for i in range(60)]
    got = propensity.binary_metrics(
        spark.createDataFrame(rows, "customer_unique_id long, repeat int, p_repeat double")).first()
    pos = [p for _, y, p in rows if y]
    neg = [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in {p for *_, p in rows}:
        hit = [y for _, y, p in rows if p >= t]
        ap += sum(1 for p in pos if p == t) / len(pos) * sum(hit) / len(hit)
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:6]
    assert got["roc_auc"] == pytest.approx(auc)
    assert got["pr_auc"] == pytest.approx(ap)
    assert got["base_rate"] == pytest.approx(len(pos) / 60)
    assert got["lift_top10"] == pytest.approx(sum(y for _, y, _ in top) / 6 / (len(pos) / 60))
    assert got["brier"] == pytest.approx(sum((p - y) ** 2 for _, y, p in rows) / 60)
