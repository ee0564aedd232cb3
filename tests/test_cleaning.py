from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tallymart.config import Config
from tallymart.operators import cleaning, joins, warehouse
from tallymart.schemas import SOURCES

CONFIG = Config()


def order(i, ts, status="delivered", delivered=None, estimated=None, customer="c1"):
    return (i, customer, status, ts, None, None, delivered, estimated)


def clean(spark, rows, **kw):
    return {r["order_id"]: r for r in cleaning.clean_orders(
        spark.createDataFrame(rows, SOURCES["orders"]), CONFIG, **kw).collect()}


def test_orders_are_unique_kept_and_in_the_window(spark):
    rows = [
        order("a", datetime(2017, 5, 1, 10)), order("a", datetime(2017, 5, 2, 10)),
        order("b", datetime(2018, 8, 19, 23, 59, 59)), order("c", datetime(2018, 8, 20)),
        order("d", datetime(2016, 12, 31, 23)), order("e", None), order("f", datetime(2017, 6, 1), "shipped"),
    ]
    got = clean(spark, rows)
    assert set(got) == {"a", "b"}
    assert got["a"]["order_purchase_timestamp"] == datetime(2017, 5, 1, 10)
    assert set(clean(spark, rows, delivered_only=False)) == {"a", "b", "f"}


def test_days_are_floored_elapsed_time(spark):
    rows = [
        order("early", datetime(2017, 5, 1, 23), delivered=datetime(2017, 5, 9, 10), estimated=datetime(2017, 5, 10)),
        order("night", datetime(2017, 5, 1, 23), delivered=datetime(2017, 5, 2, 1), estimated=datetime(2017, 5, 2)),
        order("late", datetime(2017, 5, 1, 8), delivered=datetime(2017, 5, 4, 9), estimated=datetime(2017, 5, 3)),
        order("open", datetime(2017, 5, 1, 8), estimated=datetime(2017, 5, 3)),
    ]
    got = clean(spark, rows)
    assert (got["early"]["delay_days"], got["early"]["is_late"]) == (-1, False)
    assert (got["night"]["delivery_days"], got["night"]["delay_days"]) == (0, 0)
    assert (got["late"]["delay_days"], got["late"]["is_late"]) == (1, True)
    assert (got["open"]["delay_days"], got["open"]["is_late"]) == (None, False)


def test_products_translate_with_extras_and_unknown(spark):
    def product(i, cat):
        return (i, cat, 1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0)

    products = spark.createDataFrame(
        [product("1", "brinquedos"), product("1", "brinquedos"), product("2", "pc_gamer"), product("3", None),
         product("4", "nada")], SOURCES["products"])
    names = spark.createDataFrame([("brinquedos", "toys"), ("pc_gamer", "wrong")], SOURCES["translation"])
    df = cleaning.clean_products(products, names)
    assert {r["product_id"]: r["category"] for r in df.collect()} == {
        "1": "toys", "2": "pc_gamer", "3": "unknown", "4": "unknown"}
    assert {"product_name_length", "product_description_length"} <= set(df.columns)


def test_last_review_wins_and_a_missing_answer_is_last(spark):
    def review(i, o, score, answered):
        return (i, o, score, None, None, None, answered)

    rows = [review("r1", "a", 5, datetime(2018, 1, 1)), review("r2", "a", 1, None),
            review("r3", "b", 2, datetime(2018, 1, 1)), review("r4", "b", 4, datetime(2018, 2, 1))]
    got = cleaning.clean_reviews(spark.createDataFrame(rows, SOURCES["reviews"])).collect()
    assert {r["order_id"]: r["review_score"] for r in got} == {"a": 1, "b": 4}


def test_payments_roll_up(spark):
    rows = [("a", 1, "boleto", 1, Decimal("10.10")), ("a", 2, "voucher", 3, Decimal("10.10")),
            ("b", 1, "credit_card", 2, None)]
    got = {r["order_id"]: r for r in cleaning.clean_payments(
        spark.createDataFrame(rows, SOURCES["payments"])).collect()}
    assert got["a"].asDict() == {"order_id": "a", "payment_value": Decimal("20.2000"), "payment_installments": 3,
                                 "n_payments": 2, "payment_type": "voucher"}
    assert got["b"]["payment_value"] == 0


def sources(spark):
    def frame(name, rows):
        return spark.createDataFrame(rows, SOURCES[name])

    ts = datetime(2017, 3, 6, 12)
    return {
        "orders": frame("orders", [order("o1", ts, customer="c1"), order("o2", ts, customer="c2"),
                                   order("empty", ts, customer="c2"), order("o3", ts, customer="nobody")]),
        "items": frame("items", [("o1", 1, "p1", "s", ts, Decimal("5"), Decimal("1")),
                                 ("o1", 2, "p2", "s", ts, Decimal("7"), Decimal("2")),
                                 ("o2", 1, "missing", "s", ts, Decimal("9"), Decimal("0")),
                                 ("o3", 1, "p1", "s", ts, Decimal("5"), Decimal("1"))]),
        "payments": frame("payments", [("o1", 1, "boleto", 1, Decimal("15"))]),
        "reviews": frame("reviews", [("r", "o1", 4, None, None, ts, ts)]),
        "customers": frame("customers", [("c1", "u1", "00001", "x", "SP"), ("c2", "u1", "00001", "x", None)]),
        "products": frame("products", [("p1", "brinquedos", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                                       ("p2", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]),
        "translation": frame("translation", [("brinquedos", "toys")]),
    }


def test_star_schema_grains(spark):
    w = warehouse.build(sources(spark), CONFIG)
    facts = {r["order_id"]: r for r in w.fact_orders.collect()}
    assert set(facts) == {"o1", "o2", "o3"}  # an order without items is dropped
    assert (facts["o1"]["n_items"], facts["o1"]["n_categories"]) == (2, 2)
    assert facts["o2"]["payment_value"] is None and facts["o2"]["review_score"] is None
    assert facts["o3"]["customer_unique_id"] is None
    assert {(r["order_id"], r["category"]) for r in w.fact_order_items.collect()} == {
        ("o1", "toys"), ("o1", "unknown"), ("o2", "unknown"), ("o3", "toys")}
    person = w.dim_customer.collect()
    assert [(r["customer_unique_id"], r["n_orders"], r["total_spent"], r["customer_state"]) for r in person] == [
        ("u1", 2, 15.0, "SP")]
    days = w.dim_date.collect()
    assert [(r["date"], r["week_start"], r["is_weekend"]) for r in days] == [
        (date(2017, 3, 6), date(2017, 3, 6), False)]


def test_joins_scan_each_side_once(spark):
    made = warehouse.build(sources(spark), CONFIG)
    # seven sources for the orders; for the items, joins that add nothing to them are left out
    for table, scans in ((made.fact_orders, 7), (made.fact_order_items, 6)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == scans


def test_many_to_one_keeps_hot_null_and_unmatched_rows(spark):
    # one key holds a third of the rows, some keys are null or have no partner
    many = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 0 THEN NULL ELSE id % 40 END AS k",
                                        "id AS v")
    one = spark.range(30).selectExpr("id AS k", "concat('n', id) AS name")
    rows = [(r["k"], r["v"], f"n{r['k']}" if r["k"] is not None and r["k"] < 30 else None) for r in many.collect()]
    for how in ("left", "inner"):
        got = joins.many_to_one(many, one, "k", how).select("k", "v", "name").collect()
        want = [r for r in rows if how == "left" or r[2]]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
