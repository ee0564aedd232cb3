"""Projects the TPC-H-like test tables onto the nine retail source tables.

The test tables lack delivery dates, payments and reviews, so those columns are stand-ins: arithmetic on
keys that any SQL engine can repeat.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.config import Config


def test_table_config(**changes) -> Config:
    """Parameters that fit the value ranges of the test tables."""
    base = Config(
        start=date(1995, 1, 1),
        end=date(2001, 7, 31),
        home_states=("NATION_0",),
        neighbour_states=("NATION_1", "NATION_2"),
        repeat_categories=tuple(f"Brand#{i}" for i in range(1, 13)),
    )
    return replace(base, **changes)


test_table_config.__test__ = False  # not a test case


# Declared, so that opening a table reads no file.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy source tables in the retail schema (ids stay numeric)."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    part = read_table(spark, sf_dir, "part")
    supplier = read_table(spark, sf_dir, "supplier")
    lines = read_table(spark, sf_dir, "lineitem")
    return {
        "orders": _orders(orders),
        "items": _items(lines),
        "payments": _payments(lines),
        "reviews": _reviews(lines),
        "customers": _customers(customer, nation),
        "products": _products(part),
        "sellers": _sellers(supplier, nation),
        "translation": part.selectExpr(
            "p_brand AS product_category_name", "p_brand AS product_category_name_english"
        ).distinct(),
    }


def _orders(orders: DataFrame) -> DataFrame:
    bought = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 37 % 86400)"
    delivered = f"{bought} + make_dt_interval(int(4 + o_orderkey * 11 % 19), int(o_orderkey * 5 % 24))"
    return orders.selectExpr(
        "o_orderkey AS order_id", "o_custkey AS customer_id",
        "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status",
        f"{bought} AS order_purchase_timestamp",
        f"{bought} + make_dt_interval(1) AS order_approved_at",
        f"{bought} + make_dt_interval(2) AS order_delivered_carrier_date",
        f"CASE WHEN o_orderkey % 97 <> 0 THEN {delivered} END AS order_delivered_customer_date",
        "o_orderdate + make_dt_interval(int(15 + o_orderkey * 7 % 14)) AS order_estimated_delivery_date",
    )


PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"


def _items(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "l_orderkey AS order_id", "l_linenumber AS order_item_id", "l_partkey AS product_id",
        "l_suppkey AS seller_id", "l_shipdate AS shipping_limit_date",
        f"CAST({PRICE} AS DECIMAL(18,4)) AS price",
        f"CAST({PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value",
    )


def _payments(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "l_orderkey AS order_id", "l_linenumber AS payment_sequential",
        "CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type",
        "int(l_quantity) % 10 + 1 AS payment_installments",
        f"CAST({PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS payment_value",
    )


def _reviews(lines: DataFrame) -> DataFrame:
    parts = {"l_partkey": 12, "l_suppkey": 12, "l_linenumber": 3, "l_quantity": 5}
    padded = ", ".join(f"lpad(string(bigint({c})), {w}, '0')" for c, w in parts.items())
    return lines.selectExpr(
        f"concat_ws('-', {padded}) AS review_id", "l_orderkey AS order_id",
        "int(l_linenumber % 5 + 1) AS review_score", "string(NULL) AS review_comment_title",
        "string(NULL) AS review_comment_message", "l_shipdate AS review_creation_date",
        "CASE WHEN l_partkey % 40 <> 0 THEN l_shipdate END AS review_answer_timestamp",
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        "c_custkey AS customer_id", "c_custkey AS customer_unique_id",
        "lpad(string(c_custkey % 100000), 5, '0') AS customer_zip_code_prefix",
        "c_mktsegment AS customer_city", "CASE WHEN c_custkey % 71 <> 0 THEN n_name END AS customer_state",
    )


def _products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS product_id", "CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS product_category_name",
        "double(length(p_name)) AS product_name_lenght", "double(length(p_type)) AS product_description_lenght",
        "double(p_size % 5 + 1) AS product_photos_qty", "double(p_size * 100) AS product_weight_g",
        "double(p_size) AS product_length_cm", "double(p_size) AS product_height_cm",
        "double(p_size) AS product_width_cm",
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, F.expr("s_nationkey = n_nationkey"), "left").selectExpr(
        "s_suppkey AS seller_id", "lpad(string(s_suppkey), 5, '0') AS seller_zip_code_prefix",
        "s_name AS seller_city", "n_name AS seller_state",
    )
