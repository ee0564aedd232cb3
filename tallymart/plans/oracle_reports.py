"""Oracle SQL of the star schema and the report queries."""

from __future__ import annotations

from tallymart.plans.oracle_base import mean, rate, star

TS = "'%Y-%m-%d %H:%M:%S'"


def day(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name or c.split('.')[-1]}"


def stamp(c: str, name: str) -> str:
    return f"strftime({c}, {TS}) AS {name}"


STATE_PERFORMANCE = f"""
state_performance AS (
  SELECT *, revenue / sum(revenue) OVER () AS revenue_share, avg_freight / avg_order_value AS freight_ratio
  FROM (SELECT customer_state, count(order_id) AS orders, count(DISTINCT customer_unique_id) AS customers,
               coalesce(sum(payment_value), 0)::DOUBLE AS revenue, {mean('payment_value')} AS avg_order_value,
               {mean('freight_value')} AS avg_freight, {mean('delivery_days')} AS avg_delivery_days,
               {rate('is_late')} AS late_rate, {mean('review_score')} AS avg_review
        FROM fact_orders WHERE customer_state IS NOT NULL GROUP BY customer_state))
"""
SHARES = """round(revenue_share, 9) AS revenue_share, round(freight_ratio, 9) AS freight_ratio"""
STATE_COLUMNS = f"""customer_state, orders, customers, revenue, avg_order_value, avg_freight, avg_delivery_days,
       late_rate, avg_review, {SHARES}"""

REPORTS: dict[str, str] = {
    "orders_clean": star(f"""
SELECT order_id, customer_id, order_status, {stamp('bought', 'order_purchase_timestamp')},
       {day('bought::DATE', 'order_date')} FROM orders_clean"""),
    "delivery_delay": star(f"""
SELECT order_id, {stamp('delivered', 'order_delivered_customer_date')},
       {stamp('estimated', 'order_estimated_delivery_date')}, delivery_days, delay_days, is_late
FROM orders_clean"""),
    "products_clean": star("""
SELECT product_id, product_category_name, product_name_length, product_description_length,
       (p_size % 5 + 1)::DOUBLE AS product_photos_qty, (p_size * 100)::DOUBLE AS product_weight_g,
       p_size::DOUBLE AS product_length_cm, p_size::DOUBLE AS product_height_cm,
       p_size::DOUBLE AS product_width_cm, category
FROM products_clean"""),
    "latest_review": star(f"""
SELECT order_id, review_id, review_score::BIGINT AS review_score, {stamp('answered', 'review_answer_timestamp')}
FROM latest_review"""),
    "payment_rollup": star("""
SELECT order_id, payment_value::DOUBLE AS payment_value, payment_installments, n_payments, payment_type
FROM payment_rollup"""),
    "item_totals": star("""
SELECT order_id, n_items, items_value::DOUBLE AS items_value, freight_value::DOUBLE AS freight_value, n_categories
FROM item_totals"""),
    "fact_orders": star(f"""
SELECT order_id, customer_unique_id, customer_state, customer_city,
       {stamp('bought', 'order_purchase_timestamp')}, {day('order_date')}, delivery_days, delay_days, is_late,
       review_score::BIGINT AS review_score, payment_value::DOUBLE AS payment_value, payment_installments,
       n_payments, payment_type, n_items, items_value::DOUBLE AS items_value,
       freight_value::DOUBLE AS freight_value, n_categories
FROM fact_orders"""),
    "fact_order_items": star(f"""
SELECT order_id, line::BIGINT AS order_item_id, product_id, seller_id, price::DOUBLE AS price,
       freight::DOUBLE AS freight_value, category, customer_unique_id, customer_state,
       {stamp('bought', 'order_purchase_timestamp')}, {day('order_date')}
FROM fact_items"""),
    "dim_customer": star(f"""
SELECT customer_unique_id, customer_state, customer_city, {stamp('first_order', 'first_order')},
       {stamp('last_order', 'last_order')}, n_orders, total_spent FROM dim_customer"""),
    "dim_date": star(f"""
SELECT {day('d', 'date')}, year(d) AS year, month(d) AS month, {day("date_trunc('week', d)", 'week_start')},
       isodow(d) - 1 AS dayofweek, isodow(d) >= 6 AS is_weekend,
       coalesce(strftime(d, '%m%d') IN ('0101','0421','0501','0907','1012','1102','1115','1225')
         OR (year(d) >= 2024 AND strftime(d, '%m%d') = '1120')
         OR d IN (SELECT gf FROM good_friday), FALSE) AS is_holiday,
       (month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 22 AND 28) AS is_black_friday
FROM days""", """
days AS (SELECT unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY))::DATE AS d
         FROM fact_orders)""", """
good_friday AS (
  SELECT unnest([DATE '1995-04-14', DATE '1996-04-05', DATE '1997-03-28', DATE '1998-04-10', DATE '1999-04-02',
                 DATE '2000-04-21', DATE '2001-04-13']) AS gf)"""),
    "kpis": star(f"""
SELECT count(*) AS orders, (SELECT count(*) FROM dim_customer) AS customers,
       sum(payment_value)::DOUBLE AS revenue, {mean('payment_value')} AS avg_order_value,
       (SELECT {rate('n_orders > 1')} FROM dim_customer) AS repeat_customer_rate,
       {mean('review_score')} AS avg_review_score, {rate('is_late')} AS late_delivery_rate,
       {mean('delivery_days')} AS avg_delivery_days, strftime(min(order_date), '%Y-%m-%d') AS data_start,
       strftime(max(order_date), '%Y-%m-%d') AS data_end
FROM fact_orders"""),
    "state_performance": star(f"SELECT {STATE_COLUMNS} FROM state_performance", STATE_PERFORMANCE),
    "busy_states": star(f"SELECT {STATE_COLUMNS} FROM state_performance WHERE orders >= 200", STATE_PERFORMANCE),
    "monthly_state_revenue": star(f"""
SELECT {day("date_trunc('month', order_date)", 'month')}, customer_state,
       coalesce(sum(payment_value), 0)::DOUBLE AS payment_value
FROM fact_orders WHERE customer_state IS NOT NULL GROUP BY date_trunc('month', order_date), customer_state"""),
    "category_performance": star(f"""
SELECT category, count(line) AS units, sum(price)::DOUBLE AS revenue, {mean('price')} AS avg_price,
       {mean('review_score')} AS avg_review
FROM (SELECT i.*, f.review_score FROM fact_items i JOIN fact_orders f USING (order_id)) GROUP BY category"""),
    "weekly_orders": star(f"""
SELECT {day('w', 'week')}, count(order_id) AS orders
FROM (SELECT unnest(generate_series(date_trunc('week', min(order_date))::TIMESTAMP,
                                    date_trunc('week', max(order_date))::TIMESTAMP, INTERVAL 7 DAY)) AS w
      FROM fact_orders) LEFT JOIN fact_orders ON date_trunc('week', order_date) = w
GROUP BY w"""),
    "orders_by_weekday": star("""
SELECT isodow(order_date) - 1 AS dayofweek, dayname(order_date) AS weekday, count(*) AS orders
FROM fact_orders GROUP BY 1, 2"""),
    "orders_by_hour": star("SELECT hour(bought) AS hour, count(*) AS orders FROM fact_orders GROUP BY 1"),
    "events_by_hour": "SELECT hour(ts) AS hour, count(*) AS events FROM events GROUP BY 1",
    "top_categories": star("""
SELECT category, count(price) AS items, sum(price)::DOUBLE AS revenue
FROM fact_items GROUP BY category ORDER BY sum(price) DESC, category LIMIT 15"""),
    "state_revenue": star("""
SELECT customer_state, coalesce(sum(payment_value), 0)::DOUBLE / 1000 AS revenue_k
FROM fact_orders WHERE customer_state IS NOT NULL GROUP BY customer_state"""),
    "review_distribution": star("""
SELECT review_score::BIGINT AS review_score, count(*) AS orders
FROM fact_orders WHERE review_score IS NOT NULL GROUP BY 1"""),
    "review_by_lateness": star(f"""
SELECT is_late, {mean('review_score')} AS avg_review FROM fact_orders GROUP BY is_late"""),
    "orders_per_customer_hist": star("""
SELECT n_orders, count(*) AS customers FROM dim_customer GROUP BY n_orders ORDER BY n_orders LIMIT 8"""),
    "state_delivery_summary": star(f"""
SELECT customer_state, count(order_id) AS orders, round({mean('delivery_days')}, 2) AS avg_days,
       round({rate('is_late')}, 2) AS late_rate, round({mean('review_score')}, 2) AS review
FROM fact_orders WHERE customer_state IS NOT NULL GROUP BY customer_state
ORDER BY count(order_id) DESC, customer_state LIMIT 12"""),
    "basket_mix": star(f"""
SELECT count(*) AS orders, {rate('n_items = 1')} AS single_item_share,
       {rate('n_categories = 1')} AS single_category_share FROM fact_orders"""),
}
