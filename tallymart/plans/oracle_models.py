"""Oracle SQL of the customer, forecast, propensity and affinity queries."""

from __future__ import annotations

from tallymart.plans.oracle_base import TEST_CUTOFF, mean, rate, star
from tallymart.plans.oracle_reports import day, stamp

# The test cutoff and the training cutoffs 180, 210, 240 and 270 days before it.
CUTOFFS = f"[{', '.join(f'({TEST_CUTOFF} - {d})' for d in (270, 240, 210, 180, 0))}]"
BRANDS = [f"Brand#{i}" for i in range(1, 13)]


def features(snapshots: str) -> str:
    def middle(c: str) -> str:
        ordered = f"list_sort(list({c}) FILTER ({c} IS NOT NULL))"
        n = f"count({c})"
        return f"(({ordered})[({n} + 1) // 2] + ({ordered})[({n} + 2) // 2]) / 2"

    return f"""
snaps AS (SELECT unnest({snapshots})::DATE AS snapshot),
feat_raw AS (
  SELECT snapshot, customer_unique_id, min(bought) AS first_order, max(bought) AS last_order,
         count(DISTINCT order_id) AS frequency, coalesce(sum(payment_value), 0)::DOUBLE AS monetary,
         {mean('payment_value')} AS avg_order_value, {mean('n_items')} AS avg_items,
         {mean('freight_value')} AS avg_freight, {mean('review_score')} AS avg_review,
         {mean('delivery_days')} AS avg_delivery_days, {rate('is_late')} AS late_rate,
         {mean('payment_installments')} AS avg_installments, sum(n_categories)::BIGINT AS n_categories,
         arg_max(customer_state, (bought, order_id)) FILTER (customer_state IS NOT NULL) AS customer_state,
         {rate("coalesce(payment_type = 'credit_card', FALSE)")} AS credit_card_share
  FROM fact_orders JOIN snaps ON bought < snapshot
  WHERE customer_unique_id IS NOT NULL GROUP BY snapshot, customer_unique_id),
feat_mid AS (
  SELECT snapshot, {middle('avg_review')} AS mid_review, {middle('avg_delivery_days')} AS mid_days
  FROM feat_raw GROUP BY snapshot),
features AS (
  SELECT r.* REPLACE (coalesce(avg_review, mid_review) AS avg_review,
                      coalesce(avg_delivery_days, mid_days) AS avg_delivery_days,
                      coalesce(avg_installments, 1.0) AS avg_installments),
         (snapshot - last_order::DATE)::BIGINT AS recency_days,
         (snapshot - first_order::DATE)::BIGINT AS tenure_days,
         coalesce(avg_freight / nullif(avg_order_value, 0), 0) AS freight_ratio
  FROM feat_raw r JOIN feat_mid USING (snapshot))"""


NOW = "[(SELECT max(bought)::DATE + 1 FROM fact_orders)]"
FEATURE_COLUMNS = f"""{day('snapshot')}, customer_unique_id, {stamp('first_order', 'first_order')},
       {stamp('last_order', 'last_order')}, frequency, monetary, avg_order_value, avg_items, avg_freight, avg_review,
       avg_delivery_days, late_rate, avg_installments, n_categories, customer_state, credit_card_share, recency_days,
       tenure_days, freight_ratio"""

MAIN_CATEGORY = """
main_category AS (
  SELECT snapshot, customer_unique_id, category AS main_category FROM (
    SELECT snapshot, customer_unique_id, category,
           row_number() OVER (PARTITION BY snapshot, customer_unique_id ORDER BY count(*) DESC, category DESC) AS rn
    FROM fact_items JOIN snaps ON bought < snapshot
    WHERE customer_unique_id IS NOT NULL GROUP BY snapshot, customer_unique_id, category) WHERE rn = 1)"""
ENCODED = """
encoded AS (
  SELECT f.*, m.main_category, (coalesce(customer_state = 'NATION_0', FALSE))::BIGINT AS is_sp,
         (coalesce(customer_state IN ('NATION_1', 'NATION_2'), FALSE))::BIGINT AS is_rj_mg
  FROM features f LEFT JOIN main_category m USING (snapshot, customer_unique_id))"""
CATEGORY_FLAGS = ", ".join(
    f"(coalesce(main_category = '{b}', FALSE))::BIGINT AS cat_{b.lower().replace('#', '_')}" for b in BRANDS
)


def quintile(order: str) -> str:
    return f"""greatest(1, (5 * (row_number() OVER (ORDER BY {order}) - 1) + greatest(count(*) OVER () - 1, 1) - 1)
           // greatest(count(*) OVER () - 1, 1))"""


RFM = f"""
rfm_scores AS (
  SELECT customer_unique_id, recency_days, frequency, monetary,
         {quintile('recency_days DESC, customer_unique_id')} AS R, least(frequency, 5) AS F,
         {quintile('monetary, customer_unique_id')} AS M
  FROM features),
rfm AS (
  SELECT *, R::VARCHAR || F::VARCHAR || M::VARCHAR AS rfm_score,
         CASE WHEN R >= 4 AND F >= 3 THEN 'Champions' WHEN F >= 3 AND R >= 3 THEN 'Loyal'
              WHEN F >= 3 THEN 'Can''t Lose Them' WHEN F = 2 AND R >= 3 THEN 'Potential Loyalists'
              WHEN F = 2 THEN 'At Risk' WHEN R = 5 THEN 'New Customers' WHEN R = 4 AND M >= 3 THEN 'Promising'
              WHEN R = 4 THEN 'Need Attention' WHEN R = 3 AND M >= 4 THEN 'Need Attention'
              WHEN R = 3 THEN 'Hibernating' WHEN M >= 4 THEN 'Hibernating' ELSE 'Lost' END AS segment
  FROM rfm_scores)"""

# A fixed score stands in for a fitted model, so that bands, tiers and values can be checked exactly.
SCORED = f"""
scored AS (SELECT *, 1.0::DOUBLE / (1 + recency_days) AS p_repeat FROM features),
per_repeater AS (
  SELECT coalesce(avg(n), 1.0) AS orders_per_window FROM (
    SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact_orders
    WHERE bought >= {TEST_CUTOFF} - 180 AND bought < {TEST_CUTOFF}
      AND customer_unique_id IN (SELECT customer_unique_id FROM fact_orders WHERE bought < {TEST_CUTOFF} - 180)
    GROUP BY customer_unique_id)),
banded AS (
  SELECT *, 1 - p_repeat AS churn_risk,
         ['very high', 'high', 'medium', 'low', 'very low'][{quintile('p_repeat, customer_unique_id')}] AS risk_band,
         p_repeat * (SELECT orders_per_window FROM per_repeater) * 365 / 180 AS expected_orders_12m
  FROM scored),
valued AS (SELECT *, coalesce(avg_order_value, 0) * expected_orders_12m * 1.0::DOUBLE AS clv_12m FROM banded),
clv AS (
  SELECT *, CASE WHEN 2 * (rk - 1) <= n - 1 THEN 'low' WHEN 5 * (rk - 1) <= 4 * (n - 1) THEN 'mid'
                 WHEN 20 * (rk - 1) <= 19 * (n - 1) THEN 'high' ELSE 'top 5%' END AS clv_tier
  FROM (SELECT *, row_number() OVER (ORDER BY clv_12m, customer_unique_id) AS rk, count(*) OVER () AS n FROM valued))"""
# A fixed assignment stands in for fitted clusters.
PROFILE_FEATURES = ["recency_days", "frequency", "monetary", "avg_order_value", "avg_items", "avg_review",
                    "avg_delivery_days", "late_rate", "avg_installments", "freight_ratio"]


def z(c: str) -> str:
    return (f"(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
            f"ELSE stddev_pop({c}) OVER () END)")


CLUSTERS = f"""
profile AS (
  SELECT customer_unique_id % 5 AS cluster, count(*) AS customers,
         {', '.join(f'avg({c}) AS {c}' for c in PROFILE_FEATURES)}
  FROM features GROUP BY 1),
named AS (
  SELECT *, CASE WHEN frequency >= 1.5 THEN 'Repeat buyers'
                 WHEN {z('late_rate')} > 1 OR {z('avg_review')} < -1 THEN 'Unhappy (late delivery / low review)'
                 WHEN {z('avg_items')} > 1 THEN 'Multi-item baskets' WHEN {z('monetary')} > 1 THEN 'High spenders'
                 WHEN {z('avg_installments')} > 0.5 THEN 'Installment shoppers'
                 WHEN {z('monetary')} < -0.5 THEN 'Budget one-timers' ELSE 'Regular one-timers' END AS base
  FROM profile),
clusters AS (
  SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY cluster) = 1 THEN ''
                    ELSE ' ' || row_number() OVER (PARTITION BY base ORDER BY cluster) END AS cluster_name
  FROM named)"""
MASTER = """
master AS (
  SELECT c.*, r.R, r.F, r.M, r.rfm_score, r.segment, k.cluster_name
  FROM clv c JOIN rfm r USING (customer_unique_id) JOIN clusters k ON c.customer_unique_id % 5 = k.cluster)"""
NOW_FEATURES = features(NOW)
MASTER_CTES = (NOW_FEATURES, RFM, SCORED, CLUSTERS, MASTER)
LIST_COLUMNS = """customer_unique_id, customer_state, segment, cluster_name, frequency, monetary, recency_days, p_repeat,
       churn_risk, risk_band, clv_12m, clv_tier"""

LABELS = f"""
labels_at AS (
  SELECT e.*, (EXISTS (SELECT 1 FROM fact_orders o WHERE o.customer_unique_id = e.customer_unique_id
                       AND o.bought >= e.snapshot AND o.bought < e.snapshot + 180))::BIGINT AS repeat
  FROM encoded e)"""
LABEL_CTES = (features(CUTOFFS), MAIN_CATEGORY, ENCODED, LABELS)
EVALUATED = f"""
judged AS (SELECT customer_unique_id AS id, repeat AS y, 1.0::DOUBLE / (1 + recency_days) AS p
           FROM labels_at WHERE snapshot = {TEST_CUTOFF}),
whole AS (SELECT count(*) AS n, sum(y) AS pos FROM judged),
avg_ranks AS (SELECT y, avg(r) OVER (PARTITION BY p) AS ar
              FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS r FROM judged)),
thresholds AS (SELECT p, sum(y) AS kpos, sum(sum(y)) OVER (ORDER BY p DESC) AS tp,
                      sum(count(*)) OVER (ORDER BY p DESC) AS r FROM judged GROUP BY p),
top_rows AS (SELECT y FROM judged ORDER BY p DESC, id LIMIT (SELECT greatest(1, n // 10) FROM whole))"""

AFFINITY = """
baskets AS (SELECT DISTINCT {key} AS k, category FROM fact_items WHERE category <> 'unknown' AND {key} IS NOT NULL),
singles AS (SELECT category, count(*) AS c FROM baskets GROUP BY category),
n_baskets AS (SELECT count(DISTINCT k) AS n FROM baskets),
pairs AS (SELECT x.category AS antecedent, y.category AS consequent, count(*) AS pair_count
          FROM baskets x JOIN baskets y ON x.k = y.k AND x.category <> y.category
          GROUP BY 1, 2
          HAVING count(*) >= {least} AND count(*) >= {support}::DOUBLE * (SELECT n FROM n_baskets))"""
AFFINITY_SELECT = """
SELECT antecedent, consequent, pair_count, pair_count / n AS support,
       pair_count / a.c AS confidence, (pair_count / a.c) / (b.c / n) AS lift
FROM pairs JOIN singles a ON antecedent = a.category JOIN singles b ON consequent = b.category, n_baskets"""

PANEL = """
cat_weeks AS (
  SELECT category, date_trunc('week', bought)::DATE AS week, count(*) AS n FROM fact_items GROUP BY 1, 2),
top_cats AS (
  SELECT category FROM cat_weeks WHERE category <> 'unknown' GROUP BY category
  ORDER BY sum(n) DESC, category LIMIT 15),
week_span AS (
  SELECT min(week) AS lo, max(week) - CASE WHEN (SELECT max(bought)::DATE FROM fact_items) < max(week) + 6
                                           THEN 7 ELSE 0 END AS hi FROM cat_weeks),
weeks AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY))::DATE AS week FROM week_span),
known AS (
  SELECT category AS series, week, n FROM cat_weeks WHERE category IN (SELECT category FROM top_cats)
  UNION ALL SELECT '__total__', week, sum(n) FROM cat_weeks GROUP BY week),
panel AS MATERIALIZED (
  SELECT s.series, w.week, coalesce(k.n, 0)::DOUBLE AS y
  FROM (SELECT category AS series FROM top_cats UNION ALL SELECT '__total__') s CROSS JOIN weeks w
  LEFT JOIN known k ON k.series = s.series AND k.week = w.week)"""
GOOD_FRIDAYS = """[DATE '1994-04-01', DATE '1995-04-14', DATE '1996-04-05', DATE '1997-03-28', DATE '1998-04-10',
  DATE '1999-04-02', DATE '2000-04-21', DATE '2001-04-13']"""
CALENDAR = f"""
week_days AS (SELECT week, week + i AS d FROM weeks CROSS JOIN (SELECT unnest(range(7))::INT AS i)),
fridays AS (SELECT make_date(y, 11, 1) + ((5 - isodow(make_date(y, 11, 1)) + 7) % 7)::INT + 21 AS bf
            FROM (SELECT unnest(range(1993, 2003)) AS y)),
calendar AS (
  SELECT week, weekofyear(week) AS weekofyear, month(week) AS month,
         (SELECT count(*) FROM week_days d WHERE d.week = w.week
            AND (strftime(d.d, '%m%d') IN ('0101','0421','0501','0907','1012','1102','1115','1225')
                 OR list_contains({GOOD_FRIDAYS}, d.d))) AS n_holidays,
         (EXISTS (SELECT 1 FROM fridays WHERE bf >= week AND bf < week + 7))::BIGINT AS black_friday,
         (EXISTS (SELECT 1 FROM fridays WHERE bf >= week - 7 AND bf < week))::BIGINT AS post_black_friday,
         (month(week) = 12 AND day(week) BETWEEN 8 AND 24)::BIGINT AS christmas
  FROM weeks w)"""


def earlier(fn: str, width: int) -> str:
    frame = f"OVER (PARTITION BY series ORDER BY week ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(ly) {frame} = {width} THEN {fn}(ly) {frame} END, 6)"


def lag(k: int) -> str:
    return f"round(lag(ly, {k}) OVER (PARTITION BY series ORDER BY week), 6) AS lag_{k}"


# Folds 0 (whole history) to 3 and what each baseline forecasts from them.
FOLDS = """
folds AS (SELECT k AS fold, (SELECT max(week) FROM weeks) - 56 * k AS cutoff FROM (SELECT unnest(range(4))::INT AS k)),
hist AS (SELECT fold, cutoff, series, list(y ORDER BY week) AS ys FROM panel JOIN folds ON week <= cutoff
         GROUP BY fold, cutoff, series),
steps AS (SELECT unnest(range(1, 9))::INT AS h),
baselines AS (
  SELECT fold, cutoff, series, 'naive' AS model, h, ys[len(ys)] AS yhat FROM hist, steps
  UNION ALL
  SELECT fold, cutoff, series, 'seasonal_naive', h,
         CASE WHEN len(ys) < 52 THEN ys[len(ys)] ELSE ys[len(ys) - 52 + ((h - 1) % 52) + 1] END FROM hist, steps
  UNION ALL
  SELECT fold, cutoff, series, 'moving_avg_4', h,
         list_sum(ys[greatest(len(ys) - 3, 1):len(ys)]) / least(len(ys), 4) FROM hist, steps),
fc AS MATERIALIZED (SELECT *, cutoff + 7 * h AS week FROM baselines),
bt AS MATERIALIZED (SELECT fc.*, p.y FROM fc JOIN panel p USING (series, week) WHERE fold >= 1)"""
FC = (PANEL, FOLDS)
ERRORS = """avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
       sum(abs(yhat - y)) / greatest(sum(abs(y)), 1e-9) AS wape,
       avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0 ELSE 2 * abs(yhat - y) / (abs(y) + abs(yhat)) END) AS smape,
       sum(yhat - y) / greatest(sum(abs(y)), 1e-9) AS bias"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("mae", "rmse", "wape", "smape", "bias"))
BEST = f"""
by_series AS MATERIALIZED (SELECT series, model, {ERRORS} FROM bt GROUP BY series, model),
best AS MATERIALIZED (SELECT series, model, wape FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY wape, model) AS rn FROM by_series) WHERE rn = 1)"""
INTERVALS = """
spread AS MATERIALIZED (SELECT series, model, h, quantile_cont((y - yhat) / greatest(yhat, 1), 0.1) AS q10,
                  quantile_cont((y - yhat) / greatest(yhat, 1), 0.9) AS q90 FROM bt GROUP BY series, model, h),
final AS (
  SELECT f.series, f.week, f.model, f.yhat, f.h, greatest(least(f.yhat * (1 + coalesce(q10, -0.2)), f.yhat), 0) AS lower,
         greatest(f.yhat * (1 + coalesce(q90, 0.2)), f.yhat) AS upper, coalesce(f.model = b.model, FALSE) AS is_best
  FROM fc f LEFT JOIN spread s USING (series, model, h) LEFT JOIN best b ON f.series = b.series WHERE f.fold = 0)"""
RECENT = """
recent AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY week DESC) AS back FROM panel)"""


def baseline(model: str) -> str:
    return star(f"""
SELECT series, {day('week')}, h::BIGINT AS h, round(yhat, 6) AS yhat FROM fc WHERE fold = 0 AND model = '{model}'""", *FC)


def grid_search(name: str, start: str, step: str, axes: dict[str, str], fine: str, keys: str) -> str:
    """Two grid passes as recursions over the weeks; `keys` are the parameters, ties go to the least state."""
    def run(tag: str, grid: str) -> str:
        return f"""
{name}_{tag}(series, {keys}, t, sse, u, v) AS (
  SELECT g.series, {', '.join('g.' + k for k in keys.split(', '))}, {start}
  FROM ({grid}) g JOIN pts z USING (series)
  UNION ALL
  SELECT r.series, {', '.join('r.' + k for k in keys.split(', '))}, {step}
  FROM {name}_{tag} r JOIN obs o ON o.series = r.series AND o.t = r.t + 1),
{name}_{tag}_best AS (SELECT * FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.series ORDER BY sse, u, v, {keys}) AS rn
  FROM {name}_{tag} r JOIN sizes s ON s.series = r.series AND r.t = s.n) WHERE rn = 1)"""

    coarse = "SELECT z.series, " + ", ".join(axes) + " FROM pts z, " + ", ".join(
        f"(SELECT unnest({v}) AS {k})" for k, v in axes.items()
    )
    return run("c", coarse) + "," + run("f", fine.format(best=f"{name}_c_best"))


HOLT_DATA = """
logged AS (SELECT series, list_transform(ys, lambda y: ln(1 + y)) AS ly FROM hist WHERE fold = 0),
pts AS (SELECT series, ly[1] AS a1, ly[2] - ly[1] AS a2 FROM logged),
obs AS (SELECT series, unnest(ly) AS x, generate_subscripts(ly, 1) AS t FROM logged),
sizes AS (SELECT series, len(ly) AS n FROM logged)"""
HOLT = grid_search(
    "holt", "1, 0.0::DOUBLE, z.a1, z.a2",
    """r.t + 1, r.sse + (o.x - (r.u + r.p * r.v)) * (o.x - (r.u + r.p * r.v)),
         r.a * o.x + (1 - r.a) * (r.u + r.p * r.v),
         r.b * (r.a * o.x + (1 - r.a) * (r.u + r.p * r.v) - r.u) + (1 - r.b) * (r.p * r.v)""",
    {"a": "list_transform(range(1, 10), lambda i: i / 10::DOUBLE)",
     "b": "list_transform(range(0, 5), lambda i: i / 10::DOUBLE)", "p": "[0.8::DOUBLE, 0.9, 0.98]"},
    """SELECT series, least(greatest(a + i / 40::DOUBLE, 0.01::DOUBLE), 0.99::DOUBLE) AS a,
       least(greatest(b + j / 40::DOUBLE, 0::DOUBLE), 0.99::DOUBLE) AS b,
       least(greatest(p + k / 50::DOUBLE, 0.8::DOUBLE), 0.99::DOUBLE) AS p
  FROM {best}, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j),
       (SELECT unnest(range(-2, 2)) AS k)""",
    "a, b, p",
)
ARIMA_DATA = """
logged AS (SELECT series, list_transform(ys, lambda y: ln(1 + y)) AS ly FROM hist WHERE fold = 0),
diffs AS (SELECT series, ly[len(ly)] AS last,
                 list_transform(range(2, len(ly) + 1), lambda i: ly[i] - ly[i - 1]) AS d FROM logged),
pts AS (SELECT series, d[1] AS a1 FROM diffs),
obs AS (SELECT series, unnest(d) AS x, generate_subscripts(d, 1) AS t FROM diffs),
sizes AS (SELECT series, len(d) AS n FROM diffs)"""
AXIS = "list_concat([-0.99::DOUBLE, -0.95, 0.95, 0.99], list_transform(range(-9, 10), lambda i: i / 10::DOUBLE))"
ARIMA = grid_search(
    "arima", "1, 0.0::DOUBLE, 0.0::DOUBLE, z.a1",
    """r.t + 1, r.sse + (o.x - r.f * r.v - r.th * r.u) * (o.x - r.f * r.v - r.th * r.u),
         o.x - r.f * r.v - r.th * r.u, o.x""",
    {"f": AXIS, "th": AXIS},
    """SELECT series, least(greatest(f + i / 50::DOUBLE, -0.99::DOUBLE), 0.99::DOUBLE) AS f,
       least(greatest(th + j / 50::DOUBLE, -0.99::DOUBLE), 0.99::DOUBLE) AS th
  FROM {best}, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)""",
    "f, th",
)
STEP_WEEK = "strftime((SELECT max(week) FROM weeks) + 7 * h, '%Y-%m-%d') AS week"

MODELS: dict[str, str] = {
    "customer_features": star(f"SELECT {FEATURE_COLUMNS} FROM features", NOW_FEATURES),
    "customer_features_asof": star(f"""
SELECT {FEATURE_COLUMNS}, is_sp, is_rj_mg, {CATEGORY_FLAGS}, round(ln(1 + greatest(monetary, 0)), 6) AS log_monetary
FROM encoded""", features(CUTOFFS), MAIN_CATEGORY, ENCODED),
    "customer_features_by_state": star(f"SELECT {FEATURE_COLUMNS} FROM features", features(CUTOFFS)),
    "main_category": star(f"SELECT {day('snapshot')}, customer_unique_id, main_category FROM main_category",
                          features(CUTOFFS), MAIN_CATEGORY),
    "rfm_scores": star("""
SELECT customer_unique_id, recency_days, frequency, monetary, R, F, M, rfm_score, segment FROM rfm""",
                       NOW_FEATURES, RFM),
    "segment_summary": star("""
SELECT segment, count(*) AS customers, avg(recency_days) AS avg_recency, avg(frequency) AS avg_frequency,
       round(avg(monetary), 4) AS avg_monetary, round(sum(monetary), 4) AS revenue,
       round(count(*) / sum(count(*)) OVER (), 9) AS share_customers,
       round(sum(monetary) / sum(sum(monetary)) OVER (), 9) AS share_revenue
FROM rfm GROUP BY segment""", NOW_FEATURES, RFM),
    "weekly_demand": star(f"SELECT series, {day('week')}, y FROM panel", PANEL),
    "weekly_demand_wide": star(f"""
SELECT {day('week')}, {', '.join(f'''coalesce(sum(n) FILTER (category = 'Brand#{i}'), 0)::DOUBLE
       AS brand_{i}''' for i in range(1, 26))}
FROM weeks LEFT JOIN cat_weeks USING (week) GROUP BY weeks.week, week""", PANEL),
    "calendar_features": star(f"""
SELECT {day('week')}, weekofyear, month, n_holidays, black_friday, post_black_friday, christmas FROM calendar""",
                              PANEL, CALENDAR),
    "supervised_features": star(f"""
SELECT series, {day('week')}, y, round(ly, 6) AS ly, {', '.join(lag(k) for k in (1, 2, 3, 4, 8, 12))},
       {earlier('avg', 4)} AS roll_mean_4, {earlier('avg', 8)} AS roll_mean_8,
       {earlier('stddev_samp', 4)} AS roll_std_4, weekofyear, month, n_holidays, black_friday, post_black_friday,
       christmas, code AS series_code
FROM (SELECT *, ln(1 + y) AS ly FROM panel) JOIN calendar USING (week)
JOIN (SELECT series, row_number() OVER (ORDER BY series) - 1 AS code FROM (SELECT DISTINCT series FROM panel))
  USING (series)""", PANEL, CALENDAR),
    "fc_naive": baseline("naive"),
    "fc_seasonal_naive": baseline("seasonal_naive"),
    "fc_moving_avg": baseline("moving_avg_4"),
    "fc_holt_damped": star(f"""
SELECT series, {STEP_WEEK}, h::BIGINT AS h,
       round(greatest(exp(u + v * list_sum(list_transform(range(1, h + 1), lambda k: pow(p, k)))) - 1, 0), 4) AS yhat
FROM holt_f_best, steps""", *FC, HOLT_DATA, HOLT),
    "fc_arima_111": star(f"""
SELECT series, {STEP_WEEK}, h::BIGINT AS h,
       round(greatest(exp(last + (f * v + th * u)
         * list_sum(list_transform(range(1, h + 1), lambda k: pow(f, k - 1)))) - 1, 0), 4) AS yhat
FROM arima_f_best JOIN diffs USING (series), steps""", *FC, ARIMA_DATA, ARIMA),
    "forecast_all": star(f"""
SELECT fold::BIGINT AS fold, {day('cutoff')}, series, model, h::BIGINT AS h, {day('week')}, round(yhat, 6) AS yhat
FROM fc""", *FC),
    "backtest": star(f"""
SELECT fold::BIGINT AS fold, {day('cutoff')}, series, model, h::BIGINT AS h, {day('week')}, round(yhat, 6) AS yhat, y
FROM bt""", *FC),
    "leaderboard": star(f"SELECT model, {ROUNDED} FROM (SELECT model, {ERRORS} FROM bt GROUP BY model)", *FC),
    "leaderboard_by_series": star(f"SELECT series, model, {ROUNDED} FROM by_series", *FC, BEST),
    "leaderboard_by_horizon": star(f"""
SELECT h::BIGINT AS h, round(max(wape) FILTER (model = 'naive'), 6) AS naive,
       round(max(wape) FILTER (model = 'seasonal_naive'), 6) AS seasonal_naive,
       round(max(wape) FILTER (model = 'moving_avg_4'), 6) AS moving_avg_4
FROM (SELECT h, model, {ERRORS} FROM bt GROUP BY h, model) GROUP BY h""", *FC),
    "best_models": star("SELECT series, model, round(wape, 6) AS wape FROM best", *FC, BEST),
    "forecast_intervals": star(f"""
SELECT series, {day('week')}, model, round(yhat, 6) AS yhat, h::BIGINT AS h, round(lower, 6) AS lower,
       round(upper, 6) AS upper, is_best FROM final""", *FC, BEST, INTERVALS),
    "forecast_series": star("SELECT DISTINCT series FROM panel", PANEL),
    "forecast_lookup": star(f"""
SELECT series, 'history' AS kind, {day('week')}, y, NULL::DOUBLE AS yhat, NULL::DOUBLE AS lower,
       NULL::DOUBLE AS upper, NULL::VARCHAR AS model, NULL::BOOLEAN AS is_backtest_best,
       NULL::DOUBLE AS backtest_wape
FROM recent WHERE back <= 26
UNION ALL
SELECT f.series, 'forecast', strftime(week, '%Y-%m-%d'), NULL, round(yhat, 6), round(lower, 6), round(upper, 6),
       f.model, is_best, round(b.wape, 6)
FROM final f JOIN by_series b ON f.series = b.series AND f.model = b.model WHERE is_best AND h <= 8""",
                            *FC, BEST, INTERVALS, RECENT),
    "forecast_growth": star("""
SELECT a.series, round(ahead, 6) AS ahead, past, round(ahead / nullif(past, 0) - 1, 6) AS growth
FROM (SELECT series, sum(yhat) AS ahead FROM final WHERE is_best AND series <> '__total__' GROUP BY series) a
JOIN (SELECT series, sum(y) AS past FROM recent WHERE back <= 8 GROUP BY series) b USING (series)
WHERE past <> 0""", *FC, BEST, INTERVALS, RECENT),
    "forecast_vs_actual_total": star("""
SELECT a.series, a.model, round(forecast_total, 6) AS forecast_total, actual_total,
       round(forecast_total / greatest(actual_total, 1) - 1, 6) AS change
FROM (SELECT series, model, sum(yhat) AS forecast_total FROM final WHERE h <= 8 GROUP BY series, model) a
JOIN (SELECT series, sum(y) AS actual_total FROM recent WHERE back <= 8 GROUP BY series) b USING (series)""",
                                     *FC, BEST, INTERVALS, RECENT),
    "churn_labels": star(f"""
SELECT {day('snapshot')}, customer_unique_id, recency_days, frequency, repeat FROM labels_at""", *LABEL_CTES),
    "churn_by_tables": star("""
SELECT model, customer_unique_id, repeat, TRUE AS as_fitted, TRUE AS is_probability
FROM labels_at, (VALUES ('gbt'), ('logistic')) m(model) WHERE snapshot = (SELECT max(snapshot) FROM labels_at)""",
                            *LABEL_CTES),
    "clusters_by_table": star("""
SELECT customer_unique_id, TRUE AS as_fitted, TRUE AS is_cluster FROM features""", NOW_FEATURES),
    "churn_metrics_eval": star("""
SELECT round(((SELECT sum(ar) FROM avg_ranks WHERE y = 1) - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS roc_auc,
       round((SELECT sum(kpos * tp / r) FROM thresholds) / pos, 6) AS pr_auc, round(pos / n, 6) AS base_rate,
       round((SELECT avg(y) FROM top_rows) / greatest(pos / n, 1e-9), 6) AS lift_top10,
       round((SELECT avg((p - y) * (p - y)) FROM judged), 6) AS brier
FROM whole""", *LABEL_CTES, EVALUATED),
    "score_calibration": star("""
SELECT round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS observed_rate FROM judged""", *LABEL_CTES, EVALUATED),
    "risk_bands": star("""
SELECT customer_unique_id, customer_state, recency_days, frequency, monetary, avg_order_value, p_repeat, churn_risk,
       risk_band FROM banded""", NOW_FEATURES, SCORED),
    "score_percentile": star(
        "SELECT avg((p_repeat < 0.01)::INT) AS percentile FROM scored", NOW_FEATURES, SCORED),
    "orders_per_repeater": star("SELECT orders_per_window FROM per_repeater", NOW_FEATURES, SCORED),
    "clv": star("""
SELECT customer_unique_id, avg_order_value, p_repeat, risk_band, expected_orders_12m, clv_12m, clv_tier FROM clv""",
                NOW_FEATURES, SCORED),
    "clv_share_by_tier": star("""
SELECT clv_tier, count(*) AS customers, round(sum(clv_12m), 4) AS total_clv,
       round(sum(clv_12m) / sum(sum(clv_12m)) OVER (), 9) AS share_clv FROM clv GROUP BY clv_tier""",
                              NOW_FEATURES, SCORED),
    "repeat_by_frequency": star("""
SELECT frequency, count(*) AS customers, round(avg(p_repeat), 9) AS avg_p_repeat FROM scored GROUP BY frequency""",
                                NOW_FEATURES, SCORED),
    "cluster_profile": star(f"""
SELECT cluster::BIGINT AS cluster, cluster_name, customers,
       {', '.join(f'round({c}, 4) AS {c}' for c in PROFILE_FEATURES)} FROM clusters""", NOW_FEATURES, CLUSTERS),
    "affinity_order": star(AFFINITY_SELECT, AFFINITY.format(key="order_id", least=5, support=0.0215)),
    "affinity_customer": star(AFFINITY_SELECT, AFFINITY.format(key="customer_unique_id", least=5, support=0.18)),
    "affinity_order_all": star(AFFINITY_SELECT, AFFINITY.format(key="order_id", least=5, support=0)),
    "affinity_customer_all": star(AFFINITY_SELECT, AFFINITY.format(key="customer_unique_id", least=5, support=0)),
    "affinity_top": star(AFFINITY_SELECT + " ORDER BY lift DESC, pair_count DESC, antecedent, consequent LIMIT 20",
                         AFFINITY.format(key="customer_unique_id", least=5, support=0)),
    "clv_by_segment": star("""
SELECT segment, count(*) AS customers, round(avg(clv_12m), 4) AS avg_clv, round(sum(clv_12m), 4) AS total_clv,
       round(avg(p_repeat), 9) AS p_repeat FROM master GROUP BY segment""", *MASTER_CTES),
    "rm_matrix": star(f"""
SELECT R, {', '.join(f'''round(avg(clv_12m) FILTER (M = {m}), 4) AS m{m}_avg_clv,
       count(clv_12m) FILTER (M = {m}) AS m{m}_customers''' for m in range(1, 6))}
FROM master GROUP BY R""", *MASTER_CTES),
    "segment_cluster_crosstab": star(f"""
SELECT segment, {', '.join(f'''count(*) FILTER (cluster_name = 'Repeat buyers{s}') AS "Repeat buyers{s}"'''
                           for s in ('', ' 2', ' 3', ' 4', ' 5'))}
FROM master GROUP BY segment""", *MASTER_CTES),
    "customer_list": star(f"""
SELECT {LIST_COLUMNS}, count(*) OVER () AS total FROM master WHERE segment = 'Champions'
ORDER BY clv_12m DESC, customer_unique_id LIMIT 1000""", *MASTER_CTES),
    "target_list": star(f"""
SELECT {LIST_COLUMNS.replace('churn_risk, ', '')} FROM master
WHERE segment IN ('At Risk', 'Loyal', 'Lost') AND risk_band IN ('very high', 'high', 'low')
ORDER BY recency_days, customer_unique_id LIMIT 500""", *MASTER_CTES),
    "target_export": star(f"""
SELECT {LIST_COLUMNS.replace('churn_risk, ', '')} FROM master
WHERE segment IN ('At Risk', 'Loyal', 'Lost') AND risk_band IN ('very high', 'high', 'low')""", *MASTER_CTES),
    "customer_lookup": star("""
SELECT customer_unique_id, frequency, round(monetary, 4) AS monetary, segment, clv_tier FROM master
ORDER BY monetary DESC, customer_unique_id LIMIT 1""", *MASTER_CTES),
    "target_summary": star("""
SELECT count(*) AS matched, round(sum(clv_12m), 4) AS expected_clv, round(sum(p_repeat), 6) AS expected_repeaters
FROM master WHERE segment IN ('At Risk', 'Loyal', 'Lost') AND risk_band IN ('very high', 'high', 'low')""",
                           *MASTER_CTES),
    "whatif_features": star("""
SELECT customer_unique_id, recency_days, frequency, monetary, tenure_days, avg_order_value, n_categories,
       avg_freight / nullif(avg_order_value, 0) AS freight_ratio, avg_review, credit_card_share,
       (customer_state = 'SP_NONE')::BIGINT AS is_sp
FROM (SELECT customer_unique_id, recency_days, frequency, monetary,
             greatest(recency_days + 30 * (frequency - 1), recency_days) AS tenure_days,
             monetary / frequency AS avg_order_value, frequency AS n_categories, 20.0::DOUBLE AS avg_freight,
             4.0::DOUBLE AS avg_review, 1.0::DOUBLE AS credit_card_share, 'SP' AS customer_state
      FROM features WHERE monetary > 0)""", NOW_FEATURES),
    "export_records": star(f"""
SELECT customer_unique_id, {day('snapshot')}, {day('last_order')}, avg_order_value, customer_state FROM features""",
                           NOW_FEATURES),
}
