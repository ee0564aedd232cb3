from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymart.operators import features
from tallymart.plans import job
from tallymart.sources import csv_files, driver_tables, tables


def write(folder, name, text, bom=False):
    (folder / f"{name}.csv").write_bytes((b"\xef\xbb\xbf" if bom else b"") + text.encode())


def test_csv_scan_types_text_and_bad_dates(spark, tmp_path):
    write(tmp_path, "reviews",
          'review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,'
          'review_answer_timestamp\n'
          'r1,o1,5,,"two\nlines, and ""quotes""",2018-01-01 00:00:00,2018-01-02 10:11:12\n'
          'r2,o2,1,,plain,not a date,\n')
    got = csv_files.load_table(spark, "reviews", str(tmp_path)).orderBy("review_id").collect()
    assert got[0]["review_comment_message"] == 'two\nlines, and "quotes"'
    assert got[0]["review_answer_timestamp"] == datetime(2018, 1, 2, 10, 11, 12)
    assert (got[1]["review_score"], got[1]["review_creation_date"], got[1]["review_answer_timestamp"]) == (
        1, None, None)


def test_csv_scan_drops_the_byte_order_mark_and_keeps_zips(spark, tmp_path):
    write(tmp_path, "translation", "product_category_name,product_category_name_english\nbrinquedos,toys\n", bom=True)
    write(tmp_path, "customers",
          # column order differs from the schema: names decide
          "customer_unique_id,customer_id,customer_zip_code_prefix,customer_city,customer_state\nu,c,01037,x,SP\n")
    assert csv_files.load_table(spark, "translation", str(tmp_path)).first()["product_category_name"] == "brinquedos"
    row = csv_files.load_table(spark, "customers", str(tmp_path)).first()
    assert (row["customer_id"], row["customer_zip_code_prefix"]) == ("c", "01037")


def test_load_all_and_unknown_names(spark, tmp_path):
    from tallymart.schemas import SOURCES
    for name, ddl in SOURCES.items():
        write(tmp_path, name, ",".join(c.split(" ")[0] for c in ddl.split(", ")) + "\n")
    assert "geolocation" not in csv_files.load_all(spark, str(tmp_path))
    assert set(csv_files.load_all(spark, str(tmp_path), include_geo=True)) == set(SOURCES)
    with pytest.raises(ValueError):
        csv_files.load_table(spark, "nothing", str(tmp_path))


def test_money_is_exact(spark, tmp_path):
    write(tmp_path, "payments", "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                                "o,1,boleto,1,99.33\n")
    assert csv_files.load_table(spark, "payments", str(tmp_path)).first()["payment_value"] == Decimal("99.3300")


def test_missing_tables(spark, tmp_path):
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, str(tmp_path), "customers")
    with pytest.raises(tables.MissingTable):
        tables.read_json(spark, str(tmp_path), "kpis", "a int")
    with pytest.raises(tables.MissingTable):
        tables.read_model(str(tmp_path), "model")


def test_json_round_trip(spark, tmp_path):
    df = spark.sql("SELECT double('NaN') AS a, 1.5D AS b, timestamp_ntz '2018-01-02 03:04:05' AS c, 'x' AS d")
    tables.write_json(df, str(tmp_path), "r")
    row = tables.read_json(spark, str(tmp_path), "r", "a double, b double, c string, d string").first()
    assert tuple(row) == (None, 1.5, "2018-01-02", "x")


def test_whole_job(spark, sf_dir, tmp_path):
    config = replace(driver_tables.test_table_config(), gbt_rounds=2, classifier_rounds=2, kmeans_restarts=1, ks=(3, 4))
    out = str(tmp_path)
    job.run(spark, driver_tables.source_tables(spark, sf_dir), out, config, ["warehouse", "insights"], by_month=True)
    job.run(spark, None, out, config, ["forecasting", "customers"])
    names = ("fact_orders fact_order_items dim_customer dim_product dim_date demand_weekly forecast_backtest "
             "forecast_leaderboard forecast_leaderboard_by_series forecast forecast_feature_importance customers "
             "segment_summary cluster_profile cluster_k_scores churn_metrics churn_importance affinity_order "
             "affinity_customer state_performance monthly_state_revenue category_performance").split()
    for name in names:
        assert not tables.read_table(spark, out, name).isEmpty(), name
    people = tables.read_table(spark, out, "customers")
    dim = tables.read_table(spark, out, "dim_customer")
    assert people.count() == people.select("customer_unique_id").distinct().count() == dim.count()
    assert people.where("segment IS NULL OR cluster_name IS NULL OR clv_12m IS NULL OR clv_12m < 0").isEmpty()
    assert people.where("p_repeat NOT BETWEEN 0 AND 1 OR abs(p_repeat + churn_risk - 1) > 1e-9").isEmpty()
    assert {r[0] for r in people.select("clv_tier").distinct().collect()} == {"low", "mid", "high", "top 5%"}
    orders = tables.read_table(spark, out, "fact_orders")
    assert dim.selectExpr("sum(n_orders)").first()[0] == orders.where("customer_unique_id IS NOT NULL").count()
    days = [date(1997, 3, 1), date(1997, 9, 17)]
    state = job.features_at(spark, out, days, config)
    plain = features.customer_features(orders, config, F.array(*[F.lit(d) for d in days]))
    assert state.count() > 0 and state.exceptAll(plain.select(*state.columns)).isEmpty() and state.count() == plain.count()
    demand = tables.read_table(spark, out, "demand_weekly")
    assert demand.groupBy("series").count().select("count").distinct().count() == 1
    for name in ("model_boosted_global", "model_kmeans_customers", "model_churn"):
        assert tables.read_model(out, name).stages
    with pytest.raises(ValueError):
        job.run(spark, None, out, config, ["everything"])
