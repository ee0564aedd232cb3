from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.operators import affinity, clusters, clv, features, propensity, rfm, serving

CONFIG = Config()
FACTS = ("order_id string, customer_unique_id string, customer_state string, order_purchase_timestamp timestamp_ntz, "
         "payment_value decimal(18,4), payment_installments bigint, payment_type string, n_items bigint, "
         "freight_value decimal(18,4), review_score int, delivery_days bigint, is_late boolean, n_categories bigint")


def facts(spark):
    def row(i, who, day, value, kind="credit_card", review=5, days=10, state="SP"):
        paid = None if value is None else Decimal(value)
        return (i, who, state, datetime(2018, 1, day, 15), paid, None if value is None else 2, kind, 1, Decimal(1),
                review, days, days is not None and days > 10, 1)

    return spark.createDataFrame([
        row("o1", "a", 1, "10"), row("o2", "a", 5, "30", None, None, 20, None), row("o3", "b", 3, "0", review=1),
        row("o4", "c", 9, None, "boleto", None, None), row("o5", "c", 20, None, "boleto", 3, None),
    ], FACTS)


def test_features_default_snapshot(spark):
    got = {r["customer_unique_id"]: r for r in features.customer_features(facts(spark), CONFIG).collect()}
    assert {r["snapshot"] for r in got.values()} == {date(2018, 1, 21)}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["frequency"], a["monetary"], a["avg_order_value"], a["credit_card_share"]) == (2, 40.0, 20.0, 0.5)
    assert (a["recency_days"], a["tenure_days"], a["customer_state"]) == (16, 20, "SP")
    assert b["freight_ratio"] == 0.0  # zero order value
    assert (c["monetary"], c["avg_order_value"], c["avg_installments"]) == (0.0, None, 1.0)
    assert c["avg_delivery_days"] == 12.5  # median of 15 and 10
    assert min(r["recency_days"] for r in got.values()) == 1


def test_default_snapshot_counts_orders_without_a_customer(spark):
    rows = facts(spark)
    stray = rows.where("order_id = 'o5'").withColumns({
        "order_id": F.lit("o6"), "customer_unique_id": F.lit(None).cast("string"),
        "order_purchase_timestamp": F.lit(datetime(2018, 3, 20, 9)).cast("timestamp_ntz")})
    got = features.customer_features(rows.unionByName(stray), CONFIG).collect()
    assert {r["customer_unique_id"] for r in got} == {"a", "b", "c"}
    assert {r["snapshot"] for r in got} == {date(2018, 3, 21)} and min(r["recency_days"] for r in got) == 60


def test_crosstab_adds_up(spark):
    from tallymart.operators import insights

    df = spark.range(40).selectExpr("IF(id % 2 = 0, 'Lost', 'Loyal') AS segment", "concat('c', id % 7) AS cluster_name")
    table = insights.segment_cluster_crosstab(df, ["Loyal", "Lost"]).collect()
    assert sum(sum(r[1:]) for r in table) == 40 and len(table[0]) == 8


def test_features_see_only_the_past(spark):
    days = F.array(F.lit(date(2018, 1, 4)), F.lit(date(2018, 1, 10)))
    got = features.customer_features(facts(spark), CONFIG, days).collect()
    assert {(str(r["snapshot"]), r["customer_unique_id"], r["frequency"]) for r in got} == {
        ("2018-01-04", "a", 1), ("2018-01-04", "b", 1),
        ("2018-01-10", "a", 2), ("2018-01-10", "b", 1), ("2018-01-10", "c", 1)}
    assert all(r["last_order"].date() < r["snapshot"] for r in got)


def test_labels_are_membership_in_the_window(spark):
    cut = date(2018, 1, 4)
    got = propensity.labelled(facts(spark), None, F.array(F.lit(cut)), CONFIG).collect()
    assert {r["customer_unique_id"]: r["repeat"] for r in got} == {"a": 1, "b": 0}
    names = propensity.feature_names(CONFIG)
    assert all(r[n] is not None for r in got for n in names)


def test_train_cutoffs(spark):
    row = spark.range(1).select(F.array(*propensity.train_cutoffs(F.lit(date(2018, 2, 20)), CONFIG))).first()
    assert row[0] == [date(2017, 5, 26), date(2017, 6, 25), date(2017, 7, 25), date(2017, 8, 24)]


def test_frequency_score_and_segments(spark):
    freq = spark.createDataFrame([(1,), (2,), (3,), (7,)], "f long").select(rfm.frequency_score(F.col("f")).alias("s"))
    assert [r["s"] for r in freq.collect()] == [1, 2, 3, 5]
    cells = spark.createDataFrame([(5, 4, 5), (1, 1, 1), (5, 1, 1), (3, 3, 1), (2, 5, 5), (3, 2, 1), (2, 2, 1),
                                   (4, 1, 3), (4, 1, 2), (3, 1, 4), (3, 1, 3), (1, 1, 4)], "r long, f long, m long")
    got = [r[0] for r in cells.select(rfm.segment_of(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert got == ["Champions", "Lost", "New Customers", "Loyal", "Can't Lose Them", "Potential Loyalists", "At Risk",
                   "Promising", "Need Attention", "Need Attention", "Hibernating", "Hibernating"]


def test_one_customer(spark):
    one = facts(spark).where("customer_unique_id = 'b'")
    scored = rfm.rfm(features.customer_features(one, CONFIG)).first()
    assert (scored["R"], scored["F"], scored["M"]) == (1, 1, 1)


def test_affinity_by_hand(spark):
    items = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("d", "z"), ("e", "unknown"), ("a", "x")],
        "order_id string, category string")
    got = {(r["antecedent"], r["consequent"]): r for r in affinity.category_affinity(items, "order", 1).collect()}
    rule = got["x", "y"]
    assert rule["pair_count"] == 2
    assert (rule["support"], rule["confidence"], rule["lift"]) == pytest.approx((0.5, 2 / 3, (2 / 3) / 0.5))
    assert set(got) == {("x", "y"), ("y", "x")}


def test_affinity_without_pairs(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "unknown")], "order_id string, category string")
    empty = affinity.category_affinity(items, "order", 1)
    assert empty.isEmpty() and tuple(empty.columns) == affinity.COLUMNS


def test_orders_per_repeater(spark):
    cut = F.lit(date(2018, 1, 4))
    assert clv.orders_per_repeater(facts(spark), cut, CONFIG).first()[0] == 1.0
    late = F.lit(date(2019, 1, 1))
    assert clv.orders_per_repeater(facts(spark), late, CONFIG).first()[0] == 1.0  # nobody repeats


def test_cluster_names_are_unique(spark):
    base = {c: 1.0 for c in clusters.FEATURES}
    rows = [(i, 10, *{**base, "frequency": f}.values()) for i, f in enumerate((2.0, 1.0, 3.0, 1.0))]
    cols = "cluster int, customers long, " + ", ".join(f"{c} double" for c in clusters.FEATURES)
    named = clusters.named_profile(spark.createDataFrame(rows, cols)).collect()
    assert [r["cluster_name"] for r in named] == [
        "Repeat buyers", "Regular one-timers", "Repeat buyers 2", "Regular one-timers 2"]


def test_hypothetical_defaults_and_bounds(spark):
    df = spark.createDataFrame([(1, 120, 1, 180.0, None), (2, 10, 3, 90.0, "toys"), (3, -1, 1, 1.0, None)],
                               "i int, recency_days long, frequency long, monetary double, main_category string")
    got = {r["i"]: r for r in propensity.hypothetical_features(df, CONFIG).collect()}
    assert (got[1]["tenure_days"], got[1]["n_categories"], got[1]["is_sp"]) == (120, 1, 1)
    assert (got[2]["tenure_days"], got[2]["avg_order_value"], got[2]["cat_toys"]) == (70, 30.0, 1)
    assert got[1]["freight_ratio"] == pytest.approx(20 / 180)
    assert [got[i]["invalid"] for i in (1, 2, 3)] == [None, None, "recency_days"]


def customers(spark):
    return spark.range(2000).selectExpr(
        "id AS customer_unique_id", "if(id % 2 = 0, 'Lost', 'Loyal') AS segment", "'low' AS risk_band",
        "'mid' AS clv_tier", "double(id % 100) AS clv_12m", "0.5D AS p_repeat", "0.5D AS churn_risk",
        "1.0D AS monetary", "id % 7 AS recency_days")


def test_customer_list(spark):
    got = serving.customer_list(customers(spark), segment="Lost", limit=3).collect()
    assert [(r["customer_unique_id"], r["total"]) for r in got] == [(98, 1000), (198, 1000), (298, 1000)]
    for bad in ({"sort_by": "name"}, {"limit": 0}):
        with pytest.raises(ValueError):
            serving.customer_list(customers(spark), **bad)


def test_target_list(spark):
    every = serving.target_list(customers(spark), ["Lost", "Loyal"], sort_by="recency_days")
    assert every.count() == 2000
    got = serving.target_list(customers(spark), ["Lost", "Loyal"], sort_by="recency_days", limit=500).collect()
    assert len(got) == 500 and {r["recency_days"] for r in got} == {0, 1}
    row = serving.target_summary(customers(spark), ["Loyal"]).first()
    assert (row["matched"], row["expected_repeaters"]) == (1000, 500.0)
    assert serving.customer_by_id(customers(spark), 5).count() == 1
    assert serving.customer_by_id(customers(spark), -1).isEmpty()


def test_affinity_floor_cuts_and_the_full_list_does_not(spark):
    rows = [(f"o{i}", c) for i in range(20) for c in (("a", "b") if i < 12 else ("a", "c") if i < 18 else ("b", "d"))]
    items = spark.createDataFrame(rows, "order_id string, category string")
    pairs = lambda *a: {(r["antecedent"], r["consequent"], r["pair_count"]) for r in affinity.category_affinity(items, "order", *a).collect()}
    assert pairs(5) == {("a", "b", 12), ("b", "a", 12), ("a", "c", 6), ("c", "a", 6)}
    assert pairs(5, 0.5) == {("a", "b", 12), ("b", "a", 12)}
    assert len(pairs(1)) == 6
