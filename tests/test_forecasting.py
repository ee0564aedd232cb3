from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallymart.config import TOTAL
from tallymart.operators import calendar, demand, evaluation, forecasting
from tallymart.plans import registry

MONDAY = date(2017, 1, 2)


def panel_of(spark, ys, series="s"):
    rows = [(series, MONDAY + timedelta(weeks=i), float(y)) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "series string, week date, y double")


def forecast(spark, ys, model, horizon=2):
    df = forecasting.forecast_all(panel_of(spark, ys), horizon, [0], [model])
    return [r["yhat"] for r in df.orderBy("h").collect()]


def test_baselines(spark):
    assert forecast(spark, [1, 2, 3], "naive") == [3, 3]
    assert forecast(spark, range(60), "seasonal_naive") == [8, 9]
    assert forecast(spark, [4, 9], "seasonal_naive") == [9, 9]
    assert forecast(spark, [1, 2, 3, 4, 5, 6], "moving_avg_4") == [4.5, 4.5]
    assert forecast(spark, [1, 2], "moving_avg_4") == [1.5, 1.5]


def test_short_histories_fall_back_to_the_moving_average(spark):
    ys = [3, 5, 8, 1, 2, 7, 4, 4, 6]
    assert forecast(spark, ys, "ets_damped") == [5.25, 5.25]
    assert forecast(spark, ys, "arima_111") == [5.25, 5.25]


def test_grid_models_follow_a_level(spark):
    for model in ("ets_damped", "arima_111"):
        assert forecast(spark, [20] * 40, model) == pytest.approx([20, 20])


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="unknown models"):
        forecasting.forecast_all(panel_of(spark, [1]), 1, [0], ["oracle"])


def test_black_friday_weeks(spark):
    weeks = spark.createDataFrame([(date(2017, 11, d),) for d in (13, 20, 27)], "week date")
    got = calendar.calendar_features(weeks).orderBy("week").collect()
    assert [r["black_friday"] for r in got] == [0, 1, 0]
    assert [r["post_black_friday"] for r in got] == [0, 0, 1]
    days = spark.createDataFrame([(date(2017, 1, 1),), (date(2019, 12, 31),)], "order_date date")
    flagged = calendar.dim_date(days).where("is_black_friday").orderBy("date").collect()
    assert [r["date"] for r in flagged] == [date(2017, 11, 24), date(2018, 11, 23), date(2019, 11, 22)]


def test_holidays_can_be_given(spark):
    days = spark.createDataFrame([(date(2017, 4, 13),), (date(2017, 4, 15),)], "order_date date")
    assert [r["is_holiday"] for r in calendar.dim_date(days).orderBy("date").collect()] == [False, True, False]
    own = spark.createDataFrame([(date(2017, 4, 15),)], "date date")
    assert [r["is_holiday"] for r in calendar.dim_date(days, own).orderBy("date").collect()] == [False, False, True]


def test_week_starts_on_monday(spark):
    items = spark.createDataFrame([(datetime(2017, 1, 1, 5), "a"), (datetime(2017, 1, 15, 5), "a")],
                                  "order_purchase_timestamp timestamp_ntz, category string")
    got = demand.weekly_demand(items).where(F.col("series") == "a").orderBy("week").collect()
    assert [(r["week"], r["y"]) for r in got] == [
        (date(2016, 12, 26), 1.0), (date(2017, 1, 2), 0.0), (date(2017, 1, 9), 1.0)]


def test_panel_keeps_unknown_in_the_total_and_drops_a_partial_week(spark):
    base = datetime(2017, 1, 2, 9)
    rows = [(base, c) for c in ["b", "a", "unknown", "unknown"]] + [(base + timedelta(days=7), "c")]
    items = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz, category string")
    got = {(r["series"], r["week"]): r["y"] for r in demand.weekly_demand(items, top_n=2).collect()}
    week = date(2017, 1, 2)
    assert got == {("a", week): 1.0, ("b", week): 1.0, (TOTAL, week): 4.0}  # ties go to the first names


def test_wide_and_back(spark):
    panel = panel_of(spark, [1, 2], "a").unionByName(panel_of(spark, [3, 4], "b"))
    across = demand.wide(panel, ["a", "b"])
    assert [(r["a"], r["b"]) for r in across.collect()] == [(1.0, 3.0), (2.0, 4.0)]
    assert sorted(demand.long(across, ["a", "b"]).collect()) == sorted(panel.collect())


def test_supervised_windows(spark):
    rows = demand.supervised(panel_of(spark, [0, 1, 3, 7, 15, 31])).orderBy("week").collect()
    logs = [r["ly"] for r in rows]
    assert [r["lag_1"] for r in rows] == [None, *logs[:-1]]
    assert [r["roll_mean_4"] for r in rows][:4] == [None] * 4
    assert rows[4]["roll_mean_4"] == pytest.approx(sum(logs[:4]) / 4)
    mean = sum(logs[1:5]) / 4
    assert rows[5]["roll_std_4"] == pytest.approx((sum((x - mean) ** 2 for x in logs[1:5]) / 3) ** 0.5)
    assert all(r["roll_mean_8"] is None for r in rows)


def test_metrics(spark):
    def scored(rows):
        df = spark.createDataFrame([("m", float(a), float(b)) for a, b in rows], "model string, y double, yhat double")
        return evaluation.leaderboard(df).first()

    assert scored([(1, 1), (2, 2), (3, 3)])["wape"] == 0
    got = scored([(10, 12), (0, 0), (5, 1)])
    assert (got["mae"], got["wape"], got["bias"]) == pytest.approx((2.0, 6 / 15, -2 / 15))
    assert got["smape"] == pytest.approx((4 / 22 + 0 + 8 / 6) / 3)


def test_folds_that_do_not_fit_are_dropped(spark):
    bt = forecasting.backtest(panel_of(spark, range(10)), horizon=4, n_folds=3, models=["naive"])
    assert sorted((r["fold"], r["h"]) for r in bt.collect()) == [(f, h) for f in (1, 2) for h in (1, 2, 3, 4)]


def test_intervals(spark):
    cols = "series string, model string, h int, week date, yhat double, y double"
    bt = spark.createDataFrame(
        [("s", "naive", 1, MONDAY, 10.0, y) for y in (7.0, 11.0, 12.5)], cols)
    fc = spark.createDataFrame(
        [(0, MONDAY, "s", "naive", h, MONDAY, 10.0) for h in (1, 2)],
        "fold int, cutoff date, series string, model string, h int, week date, yhat double")
    got = {r["h"]: r for r in evaluation.final_forecast(fc, bt).collect()}
    assert (got[1]["lower"], got[1]["upper"]) == pytest.approx((7.8, 12.2))
    assert (got[2]["lower"], got[2]["upper"]) == pytest.approx((8.0, 12.0))
    assert got[1]["is_best"]


def test_forecast_invariants_on_driver_data(spark, sf_dir):
    fc = registry.all_queries()["forecast_intervals"](spark, sf_dir)
    assert fc.where("lower > yhat OR yhat > upper OR lower < 0").isEmpty()
    best = fc.where("is_best").groupBy("series").count().select("count").distinct().collect()
    assert [r["count"] for r in best] == [8]


def test_lookup_errors(spark):
    panel = panel_of(spark, range(30))
    bt = forecasting.backtest(panel, 8, 2, ["naive"])
    fc = evaluation.final_forecast(forecasting.forecast_all(panel, 8, [0], ["naive"]), bt)
    lb = evaluation.leaderboard(bt, ["series", "model"])
    got = evaluation.forecast_lookup(fc, panel, lb, "s", horizon=3, history_weeks=5)
    assert [r["kind"] for r in got.collect()] == ["history"] * 5 + ["forecast"] * 3
    for args in ({"series": "x"}, {"series": "s", "model": "x"}):
        with pytest.raises(LookupError):
            evaluation.forecast_lookup(fc, panel, lb, **args)
    with pytest.raises(ValueError):
        evaluation.forecast_lookup(fc, panel, lb, "s", horizon=9)


def test_series_code_is_a_name_to_the_trees(spark):
    from tallymart.config import Config
    from tallymart.operators import boosted

    rng = range(60)
    panel = panel_of(spark, [5 + i % 3 for i in rng], "a")
    for name, level in (("b", 90), ("c", 7), ("d", 80)):
        panel = panel.unionByName(panel_of(spark, [level + i % 3 for i in rng], name))
    model = boosted.fit(panel, Config(gbt_rounds=2))
    code = len(boosted.FEATURES) - 1
    assert boosted.FEATURES[code] == "series_code"
    assert boosted.nominal(["x", "y"])["ml_attr"]["vals"] == ["x", "y"]
    text = model.stages[-1].toDebugString
    assert f"feature {code} <=" not in text  # a set of names splits, never an order of codes


def test_compiled_trees_equal_the_model_step_by_step(spark):
    import random

    from tallymart.config import Config
    from tallymart.operators import boosted
    from tallymart.operators.calendar import calendar_features

    rng = random.Random(4)
    panel = None
    for series in "abcde":
        ys = [rng.randint(0, 40) + 10 * (i % 4) * (series < "c") for i in range(40)]
        one = panel_of(spark, ys, series)
        panel = one if panel is None else panel.unionAll(one)
    model = boosted.fit(panel, Config(gbt_rounds=25))
    nodes = [n for _, tree in boosted.compiled(model) for n in tree]
    assert len(boosted.compiled(model)) == 25 and any(n.names for n in nodes) and any(n.left and n.names is None for n in nodes)
    codes = demand.supervised(panel).select("series", F.col("series_code").cast("double").alias("series_code")).distinct()
    hist = forecasting.histories(panel, 3, [0]).join(codes, "series")
    got = {(r["series"], r["h"]): r["yhat"] for r in boosted.predict(model, hist, 3).collect()}
    state = hist.select("series", "series_code", "cutoff", F.expr("transform(ys, y -> log1p(y))").alias("tail"))
    for h in (1, 2, 3):
        row = state.withColumn("week", F.date_add("cutoff", 7 * h))
        row = row.join(calendar_features(row.select("week").distinct()), "week")
        row = row.withColumns({c: F.expr(e) for c, e in boosted._step_features("tail").items()})
        made = model.transform(row).withColumn("yhat", F.greatest(F.expm1("predicted"), F.lit(0.0))).cache()
        for r in made.collect():
            assert got[r["series"], h] == pytest.approx(r["yhat"], abs=1e-9)
        state = made.select("series", "series_code", "cutoff", F.concat("tail", F.array(F.log1p("yhat"))).alias("tail"))
    assert len(got) == 15 and len(set(got.values())) > 5
