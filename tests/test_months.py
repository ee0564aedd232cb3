"""Facts stored by month: pruned bounds, and customer features from stored months."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.operators import customer_state, features, months, propensity
from tallymart.sources import tables
from test_customers import FACTS

CONFIG = Config()
START = datetime(2017, 11, 28)


def made_orders(n=400, seed=3):
    """Orders at month edges too; a third belong to one customer, some to none, some have no time."""
    rng = random.Random(seed)
    edges = [datetime(2018, m, 1) + timedelta(microseconds=k) for m in (1, 2, 3) for k in (-1, 0, 1)]
    rows = []
    for i in range(n):
        when = edges[i] if i < len(edges) else START + timedelta(minutes=rng.randrange(60 * 24 * 130))
        when = None if i % 41 == 40 else when
        who = "hot" if i % 3 == 0 else None if i % 37 == 36 else f"c{rng.randrange(60)}"
        paid = None if i % 11 == 10 else Decimal(rng.randrange(0, 9000)) / 100
        rows.append((f"o{i}", who, rng.choice(["SP", "RJ", None]), when, paid, rng.choice([None, 1, 3]),
                     rng.choice(["credit_card", "boleto", None]), rng.randrange(1, 4), Decimal(rng.randrange(900)) / 100,
                     rng.choice([None, 1, 5]), rng.choice([None, 3, 20]), rng.random() < 0.2, rng.randrange(1, 3)))
    return rows


def by_month(spark, folder, rows):
    df = spark.createDataFrame(rows, FACTS)
    tables.write_tables({"fact_orders": months.with_month(df)}, folder, {"fact_orders": months.MONTH})
    return tables.read_table(spark, folder, "fact_orders")


def months_read(df):
    """The months whose files the plan's scans of the stored orders would read."""
    return {p.split(f"{months.MONTH}=")[1].split("/")[0] for p in
            df.select(F.input_file_name().alias("p")).distinct().toPandas()["p"]}


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).collect()))


DAYS = [date(2018, 1, 1), date(2018, 2, 1), date(2018, 2, 2), date(2018, 2, 17), date(2018, 3, 9)]


def test_state_equals_recompute(spark, tmp_path):
    rows = made_orders()
    facts, state = by_month(spark, str(tmp_path), rows), str(tmp_path / "state")
    done = customer_state.update(facts, state, CONFIG)
    assert done[0] == date(2017, 11, 1) and len(done) == 6
    want = features.customer_features(facts, CONFIG, F.array(*[F.lit(d) for d in DAYS]))
    got = customer_state.features(facts, state, DAYS, CONFIG)
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
    unstored = spark.createDataFrame(rows, FACTS)  # the same without month folders
    assert rows_of(customer_state.features(unstored, state, DAYS[2:3], CONFIG)) == rows_of(
        features.customer_features(unstored, CONFIG, F.array(F.lit(DAYS[2]))))


def test_update_touches_only_changed_months(spark, tmp_path):
    rows, state = made_orders(), str(tmp_path / "state")
    early = [r for r in rows if r[3] is None or r[3] < datetime(2018, 2, 1)]
    assert customer_state.update(by_month(spark, str(tmp_path / "a"), early), state, CONFIG)[-1] == date(2018, 1, 1)
    facts = by_month(spark, str(tmp_path / "b"), rows)
    assert customer_state.update(facts, state, CONFIG) == [date(2018, 2, 1), date(2018, 3, 1), date(2018, 4, 1)]
    assert customer_state.update(facts, state, CONFIG) == []

    late = ("late", "c1", "MG", datetime(2017, 12, 31, 23, 59), Decimal(7), 1, "boleto", 1, Decimal(1), 5, 3, False, 1)
    more = [r for r in rows if not (r[3] and r[3].month == 11)] + [late]  # and November is withdrawn
    facts = by_month(spark, str(tmp_path / "c"), more)
    assert customer_state.update(facts, state, CONFIG) == [date(2017, 11, 1), date(2017, 12, 1)]
    fixed = [(*r[:4], Decimal(1), *r[5:]) if r[0] == "late" else r for r in more]
    facts = by_month(spark, str(tmp_path / "d"), fixed)
    assert customer_state.update(facts, state, CONFIG) == []  # a correction leaves the count as it is
    assert customer_state.update(facts, state, CONFIG, [date(2017, 12, 15)]) == [date(2017, 12, 1)]
    want = features.customer_features(facts, CONFIG, F.array(*[F.lit(d) for d in DAYS]))
    assert rows_of(customer_state.features(facts, state, DAYS, CONFIG)) == rows_of(want)


def test_bounds_read_only_their_months(spark, tmp_path):
    rows = made_orders()
    facts = by_month(spark, str(tmp_path), rows)
    plain = facts.drop(months.MONTH)
    for first, end in [(date(2018, 1, 1), date(2018, 2, 1)), (date(2018, 1, 31), date(2018, 2, 2)), (None, date(2018, 1, 1)),
                       (date(2018, 3, 31), None), (None, None)]:
        limits = [None if d is None else F.lit(d) for d in (first, end)]
        got = months.bought_between(facts, *limits)
        assert rows_of(got.drop(months.MONTH)) == rows_of(months.bought_between(plain, *limits))
        if first is not None or end is not None:
            assert all(str(first or "")[:7] <= m[:7] < str(end or "9") for m in months_read(got))


def scans(df, capsys):
    df.collect()
    capsys.readouterr()
    df.explain("formatted")
    return [line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line]


def test_scalar_bounds_prune_in_the_plan(spark, tmp_path, capsys):
    facts = by_month(spark, str(tmp_path), made_orders())
    cut = facts.agg(F.date_sub(F.max(F.col("order_purchase_timestamp").cast("date")), 60)).scalar()
    found = scans(months.bought_between(facts, cut, F.date_add(cut, 20)), capsys)
    assert any(months.MONTH in line and "subquery" in line.lower() for line in found), found

    days = F.array(F.lit(date(2018, 1, 10)), F.lit(date(2018, 2, 1)))
    found = scans(features.main_category(facts.withColumn("category", F.lit("x")), days), capsys)
    assert any(f"{months.MONTH}" in line and "2018-01-01" in line for line in found), found
    found = scans(propensity.labelled(facts, None, days, CONFIG), capsys)
    assert any(f"{months.MONTH}" in line and ">= 2018-01-01" in line for line in found), found


def test_empty_and_missing(spark, tmp_path):
    none = spark.createDataFrame([], FACTS)
    assert customer_state.update(none, str(tmp_path / "state"), CONFIG) == []
    with pytest.raises(tables.MissingTable):
        customer_state.features(none, str(tmp_path / "state"), DAYS, CONFIG)
    undated = spark.createDataFrame([("o", "a", "SP", None, *made_orders(1)[0][4:])], FACTS)
    assert customer_state.update(undated, str(tmp_path / "state"), CONFIG) == []
