"""SQL text shared by the oracles: the source stand-ins and the star schema, as common table expressions."""

from __future__ import annotations

# Analysis window and split dates of the test tables.
START, END_NEXT = "DATE '1995-01-01'", "DATE '2001-08-01'"
TEST_CUTOFF = "DATE '2001-02-01'"

SOURCES = """
src_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
         o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS bought,
         CASE WHEN o_orderkey % 97 <> 0 THEN
           o_orderdate + to_seconds(o_orderkey * 37 % 86400)
             + to_hours((4 + o_orderkey * 11 % 19) * 24 + o_orderkey * 5 % 24) END AS delivered,
         o_orderdate + to_days((15 + o_orderkey * 7 % 14)::INT) AS estimated
  FROM orders),
src_lines AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, l_linenumber AS line,
         l_quantity::BIGINT AS qty, l_returnflag AS rf, l_shipdate AS shipped,
         l_extendedprice::DECIMAL(14,2) AS price,
         l_extendedprice::DECIMAL(14,2) * l_tax::DECIMAL(4,2) AS freight,
         l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2)) AS paid
  FROM lineitem),
src_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_mktsegment AS customer_city,
         lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS customer_zip_code_prefix,
         CASE WHEN c_custkey % 71 <> 0 THEN n_name END AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
"""

STAR = SOURCES + """,
orders_clean AS (
  SELECT *, floor(epoch_us(delivered - bought) / 86400e6)::BIGINT AS delivery_days,
         floor(epoch_us(delivered - estimated) / 86400e6)::BIGINT AS delay_days,
         coalesce(floor(epoch_us(delivered - estimated) / 86400e6) > 0, FALSE) AS is_late
  FROM src_orders
  WHERE order_status = 'delivered' AND bought >= {start} AND bought < {end_next}),
products_clean AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS product_category_name,
         CASE WHEN p_partkey % 50 <> 0 THEN p_brand ELSE 'unknown' END AS category,
         length(p_name)::DOUBLE AS product_name_length, length(p_type)::DOUBLE AS product_description_length,
         p_size
  FROM part),
latest_review AS (
  SELECT order_id, review_id, review_score, answered FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id
             ORDER BY (answered IS NULL) DESC, answered DESC, review_id DESC, review_score DESC) AS rn
    FROM (SELECT order_id, line % 5 + 1 AS review_score,
                 CASE WHEN product_id % 40 <> 0 THEN shipped END AS answered,
                 lpad(product_id::VARCHAR, 12, '0') || '-' || lpad(seller_id::VARCHAR, 12, '0') || '-'
                   || lpad(line::VARCHAR, 3, '0') || '-' || lpad(qty::VARCHAR, 5, '0') AS review_id
          FROM src_lines)) WHERE rn = 1),
pay_rows AS (
  SELECT order_id, line AS payment_sequential, paid AS payment_value, (qty % 10 + 1)::BIGINT AS installments,
         CASE rf WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type
  FROM src_lines),
payment_rollup AS (
  SELECT a.order_id, a.payment_value, a.payment_installments, a.n_payments, m.payment_type
  FROM (SELECT order_id, sum(payment_value) AS payment_value, max(installments) AS payment_installments,
               count(payment_sequential) AS n_payments FROM pay_rows GROUP BY order_id) a
  JOIN (SELECT order_id, payment_type FROM (
          SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY payment_value DESC, payment_type DESC) AS rn
          FROM pay_rows) WHERE rn = 1) m USING (order_id)),
items_cat AS (
  SELECT l.*, coalesce(p.category, 'unknown') AS category
  FROM src_lines l LEFT JOIN products_clean p USING (product_id)),
item_totals AS (
  SELECT order_id, count(*) AS n_items, sum(price) AS items_value, sum(freight) AS freight_value,
         count(DISTINCT category) AS n_categories
  FROM items_cat GROUP BY order_id),
fact_orders AS (
  SELECT o.order_id, c.customer_unique_id, c.customer_state, c.customer_city, o.bought, o.bought::DATE AS order_date,
         o.delivered, o.delivery_days, o.delay_days, o.is_late, r.review_score, p.payment_value,
         p.payment_installments, p.n_payments, p.payment_type, t.n_items, t.items_value, t.freight_value,
         t.n_categories
  FROM orders_clean o JOIN item_totals t USING (order_id)
  LEFT JOIN src_customers c USING (customer_id)
  LEFT JOIN latest_review r USING (order_id)
  LEFT JOIN payment_rollup p USING (order_id)),
fact_items AS (
  SELECT i.*, f.customer_unique_id, f.customer_state, f.bought, f.order_date
  FROM items_cat i JOIN fact_orders f USING (order_id)),
dim_customer AS (
  SELECT customer_unique_id,
         arg_max(customer_state, (bought, order_id)) FILTER (customer_state IS NOT NULL) AS customer_state,
         arg_max(customer_city, (bought, order_id)) FILTER (customer_city IS NOT NULL) AS customer_city,
         min(bought) AS first_order, max(bought) AS last_order, count(DISTINCT order_id) AS n_orders,
         coalesce(sum(payment_value), 0)::DOUBLE AS total_spent
  FROM fact_orders WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id)
""".format(start=START, end_next=END_NEXT)


def star(select: str, *ctes: str) -> str:
    """A query over the star schema, with further common table expressions before the select."""
    return "WITH RECURSIVE " + ",\n".join([STAR, *ctes]) + "\n" + select


def mean(c: str) -> str:
    """Mean from an exact sum, the division done in double precision."""
    return f"(sum({c})::DOUBLE / nullif(count({c}), 0))"


def rate(c: str) -> str:
    return f"(sum(({c})::INT)::DOUBLE / count(*))"
