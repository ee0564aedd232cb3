"""Named queries over the test tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType, ShortType, TimestampNTZType

from tallymart.operators import (
    affinity,
    boosted,
    calendar,
    cleaning,
    clusters,
    clv,
    customer_state,
    demand,
    evaluation,
    features,
    forecasting,
    insights,
    model_tables,
    months,
    propensity,
    rfm,
    serving,
    warehouse,
)
from tallymart.operators.warehouse import Warehouse
from tallymart.plans import customers
from tallymart.session import stage_table, staging_root
from tallymart.sources import driver_tables, tables

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = driver_tables.test_table_config()
TEST_CUTOFF = CONFIG.end - timedelta(days=CONFIG.window_days)


def show(df: DataFrame, digits: int | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """Report form: days and timestamps as ISO text, exact money as double, whole numbers as bigint.

    `digits` rounds doubles (those in `only`, or all) whose last bits depend on the order of summation.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DateType, TimestampNTZType)):
            c = c.cast("string")  # formatting functions would go through the session time zone
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        elif digits is not None and f.dataType.typeName() == "double" and (not only or f.name in only):
            c = F.round(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


_kept: dict[str, Warehouse] = {}


_fitted: dict[tuple[str, str, str], object] = {}


def serve_from(sf_dir: str, stored: Warehouse) -> None:
    """Let the queries on this folder read a stored star schema instead of planning it from the sources."""
    _kept[sf_dir] = stored
    for key in [k for k in _fitted if k[1] == sf_dir]:
        del _fitted[key]


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What `make` fits, kept for the other queries of this application on the same folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def star(spark: SparkSession, sf_dir: str) -> Warehouse:
    return _kept.get(sf_dir) or warehouse.build(driver_tables.source_tables(spark, sf_dir), CONFIG)


def _warehouse_queries() -> dict[str, Query]:
    def sources(spark, d):
        return driver_tables.source_tables(spark, d)

    def orders_clean(spark, d):
        df = cleaning.clean_orders(sources(spark, d)["orders"], CONFIG)
        return show(df.select(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp",
            F.col("order_purchase_timestamp").cast("date").alias("order_date"),
        ))

    def delivery_delay(spark, d):
        df = cleaning.clean_orders(sources(spark, d)["orders"], CONFIG)
        return show(df.select(
            "order_id", "order_delivered_customer_date", "order_estimated_delivery_date", "delivery_days",
            "delay_days", "is_late",
        ))

    def products_clean(spark, d):
        s = sources(spark, d)
        return show(cleaning.clean_products(s["products"], s["translation"]))

    def latest_review(spark, d):
        df = cleaning.clean_reviews(sources(spark, d)["reviews"])
        return show(df.select("order_id", "review_id", "review_score", "review_answer_timestamp"))

    def payment_rollup(spark, d):
        return show(cleaning.clean_payments(sources(spark, d)["payments"]))

    def item_totals(spark, d):
        s = sources(spark, d)
        products = cleaning.clean_products(s["products"], s["translation"])
        return show(warehouse.item_totals(warehouse.categorised_items(s["items"], products)))

    def fact_orders(spark, d):
        return show(star(spark, d).fact_orders.select(
            "order_id", "customer_unique_id", "customer_state", "customer_city", "order_purchase_timestamp",
            "order_date", "delivery_days", "delay_days", "is_late", "review_score", "payment_value",
            "payment_installments", "n_payments", "payment_type", "n_items", "items_value", "freight_value",
            "n_categories",
        ))

    def fact_order_items(spark, d):
        return show(star(spark, d).fact_order_items.select(
            "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "category",
            "customer_unique_id", "customer_state", "order_purchase_timestamp", "order_date",
        ))

    return {
        "orders_clean": orders_clean,
        "delivery_delay": delivery_delay,
        "products_clean": products_clean,
        "latest_review": latest_review,
        "payment_rollup": payment_rollup,
        "item_totals": item_totals,
        "fact_orders": fact_orders,
        "fact_order_items": fact_order_items,
        "dim_customer": lambda spark, d: show(star(spark, d).dim_customer),
        "dim_date": lambda spark, d: show(star(spark, d).dim_date),
    }


def _report_queries() -> dict[str, Query]:
    shares = ("revenue_share", "freight_ratio")

    def on_facts(fn, digits=None, only=()):
        return lambda spark, d: show(fn(star(spark, d).fact_orders), digits, only)

    def kpis(spark, d):
        w = star(spark, d)
        return show(insights.kpis(w.fact_orders, w.dim_customer))

    def category_performance(spark, d):
        w = star(spark, d)
        return show(insights.category_performance(w.fact_order_items, w.fact_orders))

    def busy_states(facts):
        return insights.busy_states(insights.state_performance(facts), 200)

    def events_by_hour(spark, d):
        return show(insights.counts_by_hour(driver_tables.read_table(spark, d, "events"), "ts", "events"))

    return {
        "kpis": kpis,
        "state_performance": on_facts(insights.state_performance, 9, shares),
        "busy_states": on_facts(busy_states, 9, shares),
        "monthly_state_revenue": on_facts(insights.monthly_state_revenue),
        "category_performance": category_performance,
        "weekly_orders": on_facts(insights.weekly_orders),
        "orders_by_weekday": on_facts(insights.orders_by_weekday),
        "orders_by_hour": on_facts(lambda f: insights.counts_by_hour(f, "order_purchase_timestamp")),
        "events_by_hour": events_by_hour,
        "top_categories": lambda spark, d: show(
            insights.top_categories_by_revenue(star(spark, d).fact_order_items)
        ),
        "state_revenue": on_facts(insights.state_revenue_thousands),
        "review_distribution": on_facts(insights.review_distribution),
        "review_by_lateness": on_facts(insights.review_by_lateness),
        "orders_per_customer_hist": lambda spark, d: show(
            insights.orders_per_customer(star(spark, d).dim_customer)
        ),
        "state_delivery_summary": on_facts(insights.state_delivery_summary),
        "basket_mix": on_facts(insights.basket_mix),
    }


def _history_parts(spark, d):
    return stage_table(demand.weekly_demand(star(spark, d).fact_order_items, CONFIG.top_n), "panel")


def _demand_queries() -> dict[str, Query]:
    baselines = ["naive", "seasonal_naive", "moving_avg_4"]

    def panel(spark, d):
        return demand.weekly_demand(star(spark, d).fact_order_items, CONFIG.top_n)

    def weekly_demand_wide(spark, d):
        # every brand, so the columns are known without asking the data
        brands = [f"Brand#{i}" for i in range(1, 26)]
        full = demand.weekly_demand(star(spark, d).fact_order_items, len(brands))
        named = {b: b.lower().replace("#", "_") for b in brands}
        return show(demand.wide(full, brands).fillna(0.0).withColumnsRenamed(named))

    def calendar_features(spark, d):
        return show(calendar.calendar_features(panel(spark, d).select("week").distinct()))

    def supervised_features(spark, d):
        return show(demand.supervised(_history_parts(spark, d)), 6)

    def one_model(model, digits):
        def run(spark, d):
            fc = forecasting.forecast_all(_history_parts(spark, d), CONFIG.horizon, [0], [model])
            return show(fc.select("series", "week", "h", "yhat"), digits)
        return run

    def forecast_all(spark, d):
        fc = forecasting.forecast_all(_history_parts(spark, d), CONFIG.horizon, range(4), baselines)
        return show(fc, 6)

    def tested(p):
        return forecasting.backtest(p, CONFIG.horizon, CONFIG.n_folds, baselines)

    def on_backtest(fn):
        return lambda spark, d: show(fn(tested(_history_parts(spark, d))), 6)

    def final(p):
        ahead = forecasting.forecast_all(p, CONFIG.horizon, [0], baselines)
        return evaluation.final_forecast(ahead, tested(p))

    def forecast_lookup(spark, d):
        p = _history_parts(spark, d)
        by_series = evaluation.leaderboard(tested(p), ["series", "model"])
        return show(evaluation.forecast_lookup(final(p), p, by_series), 6)

    def with_panel(fn):
        def run(spark, d):
            p = _history_parts(spark, d)
            return show(fn(final(p), p), 6)
        return run

    def boosted_final(spark, d):
        """The forecast of the last fold, which two queries read."""
        return once(spark, d, "boosted", lambda: boosted.boosted_forecasts(
            _history_parts(spark, d), CONFIG.horizon, [0], CONFIG))

    def fc_gbt_global(spark, d):
        return show(boosted_final(spark, d).select("series", "week", "h", "yhat"), 6)

    def fc_ensemble(spark, d):
        def fitted(panel, horizon, folds):
            return boosted_final(spark, d)

        fc = forecasting.forecast_all(_history_parts(spark, d), CONFIG.horizon, [0], boosted=fitted)
        ours = fc.where(F.col("model") == forecasting.ENSEMBLE)
        return show(ours.select("series", "week", "h", "yhat"), 6)

    def every_model(spark, d, folds):
        """Forecasts of all seven models, with the panel; the trees are fitted anew for each fold."""
        def fitted(panel, horizon, of):
            return boosted.boosted_forecasts(panel, horizon, of, CONFIG)

        p = _history_parts(spark, d)
        return p, stage_table(forecasting.forecast_all(p, CONFIG.horizon, folds, boosted=fitted), "forecasts")

    def forecast_all_seven(spark, d):
        return show(every_model(spark, d, range(CONFIG.n_folds + 1))[1], 6)

    def on_seven(fn):
        def run(spark, d):
            p, fc = every_model(spark, d, range(1, CONFIG.n_folds + 1))
            return show(fn(fc.join(p, ["series", "week"]).select(*forecasting.COLUMNS, "y")), 6)
        return run

    def forecast_lookup_seven(spark, d):
        p, fc = every_model(spark, d, range(CONFIG.n_folds + 1))
        tested_all = fc.where(F.col("fold") > 0).join(p, ["series", "week"]).select(*forecasting.COLUMNS, "y")
        ahead = evaluation.final_forecast(fc.where(F.col("fold") == 0), tested_all)
        return show(evaluation.forecast_lookup(ahead, p, evaluation.leaderboard(tested_all, ["series", "model"])), 6)

    def forecast_importance(spark, d):
        return show(boosted.feature_importance(boosted.fit(_history_parts(spark, d), CONFIG)), 6)

    return {
        "weekly_demand": lambda spark, d: show(panel(spark, d)),
        "weekly_demand_wide": weekly_demand_wide,
        "calendar_features": calendar_features,
        "supervised_features": supervised_features,
        "fc_naive": one_model("naive", 6),
        "fc_seasonal_naive": one_model("seasonal_naive", 6),
        "fc_moving_avg": one_model("moving_avg_4", 6),
        "fc_holt_damped": one_model("ets_damped", 4),
        "fc_arima_111": one_model("arima_111", 4),
        "fc_gbt_global": fc_gbt_global,
        "fc_ensemble": fc_ensemble,
        "forecast_importance": forecast_importance,
        "forecast_all": forecast_all,
        "backtest": on_backtest(lambda bt: bt),
        "leaderboard": on_backtest(evaluation.leaderboard),
        "leaderboard_by_series": on_backtest(lambda bt: evaluation.leaderboard(bt, ["series", "model"])),
        "leaderboard_by_horizon": on_backtest(lambda bt: evaluation.error_by_horizon(bt, baselines)),
        "best_models": on_backtest(evaluation.best_models),
        "forecast_all_seven": forecast_all_seven,
        "backtest_seven": on_seven(lambda bt: bt),
        "leaderboard_seven": on_seven(evaluation.leaderboard),
        "leaderboard_by_series_seven": on_seven(lambda bt: evaluation.leaderboard(bt, ["series", "model"])),
        "leaderboard_by_horizon_seven": on_seven(lambda bt: evaluation.error_by_horizon(bt, forecasting.ALL_MODELS)),
        "best_models_seven": on_seven(evaluation.best_models),
        "forecast_lookup_seven": forecast_lookup_seven,
        "forecast_intervals": with_panel(lambda fc, p: fc),
        "forecast_series": with_panel(lambda fc, p: evaluation.forecast_series(fc)),
        "forecast_lookup": forecast_lookup,
        "forecast_growth": with_panel(evaluation.forecast_growth),
        "forecast_vs_actual_total": with_panel(
            lambda fc, p: evaluation.forecast_against_actual(fc, p, CONFIG.horizon)
        ),
    }


def _fixed_score(df: DataFrame) -> DataFrame:
    """A fixed score in place of a fitted model, so that what is built on scores can be checked exactly."""
    p = F.lit(1.0) / (1 + F.col("recency_days"))
    return df.withColumn("p_repeat", p).withColumn("churn_risk", 1 - F.col("p_repeat"))


def _customer_queries() -> dict[str, Query]:
    clv_digits = 4

    def features_now(spark, d):
        return features.customer_features(star(spark, d).fact_orders, CONFIG)

    def cutoff_days():
        last = F.lit(TEST_CUTOFF)
        return F.array(*propensity.train_cutoffs(last, CONFIG), last)

    def customer_features_asof(spark, d):
        w = star(spark, d)
        df = features.customer_features(w.fact_orders, CONFIG, cutoff_days())
        df = features.with_categories(df, w.fact_order_items, CONFIG, cutoff_days())
        df = features.with_state_flags(df, CONFIG).drop("main_category")
        df = features.log_columns(df.withColumn("log_monetary", F.col("monetary")), ["log_monetary"])
        return show(df, 6, ("log_monetary",))

    def customer_features_by_state(spark, d):
        """The same days from months: the state is made up to the first day's month, then brought up to date."""
        root = f"{staging_root(spark)}/by-month-{uuid.uuid4().hex}"
        tables.write_tables(
            {"fact_orders": months.with_month(star(spark, d).fact_orders)}, root, {"fact_orders": months.MONTH})
        facts, state = tables.read_table(spark, root, "fact_orders"), f"{root}/customer_state"
        back = [CONFIG.window_days + CONFIG.step_days * i for i in range(CONFIG.train_cutoffs)]
        days = [TEST_CUTOFF, *[TEST_CUTOFF - timedelta(days=n) for n in back]]
        customer_state.update(months.bought_between(facts, None, F.lit(min(days))), state, CONFIG)
        customer_state.update(facts, state, CONFIG)
        return show(customer_state.features(facts, state, days, CONFIG))

    def main_category(spark, d):
        return show(features.main_category(star(spark, d).fact_order_items, cutoff_days()))

    def churn_labels(spark, d):
        w = star(spark, d).staged("fact_orders")  # read for the cutoff, the features and the labels
        days = F.array(*propensity.train_cutoffs(propensity.test_cutoff(w.fact_orders, CONFIG), CONFIG),
                       propensity.test_cutoff(w.fact_orders, CONFIG))
        df = propensity.labelled(w.fact_orders, None, days, CONFIG)
        return show(df.select("snapshot", "customer_unique_id", "recency_days", "frequency", "repeat"))

    def judged(spark, d):
        w = star(spark, d).staged("fact_orders")
        return _fixed_score(propensity.labelled(w.fact_orders, None, F.array(F.lit(TEST_CUTOFF)), CONFIG))

    def trained(spark, d):
        def fit():
            w = star(spark, d).staged("fact_orders")
            return w, propensity.train_and_evaluate(w.fact_orders, w.fact_order_items, CONFIG)

        return once(spark, d, "propensity", fit)

    def churn_train(spark, d):
        return show(trained(spark, d)[1].metrics, 6)

    def churn_importance(spark, d):
        return show(propensity.importance(trained(spark, d)[1].model, CONFIG), 6)

    def churn_scores(spark, d):
        w, done = trained(spark, d)
        return show(propensity.score_customers(done.model, w.fact_orders, w.fact_order_items, CONFIG), 6)

    def churn_by_tables(spark, d):
        """Both classifiers scored from their tables at the test cutoff, against the fitted pipelines."""
        done = trained(spark, d)[1]
        names = propensity.feature_names(CONFIG)
        inputs = F.array(*[F.col(f"x_{n}") for n in names])
        out = None
        for name, model in done.models.items():
            last = model.stages[-1]
            rows = model.transform(done.test).select(
                "customer_unique_id", "repeat", vector_to_array("probability")[1].alias("fitted"), *[f"x_{n}" for n in names]
            )
            if name == propensity.LOGISTIC:
                scored = model_tables.linear_probability(rows, model_tables.linear_table(spark, model, names), inputs)
            else:
                table = model_tables.tree_table(spark, model)
                scored = model_tables.tree_probability(rows, table, inputs, last.getMaxDepth())
            one = scored.select(
                F.lit(name).alias("model"), "customer_unique_id", "repeat",
                (F.abs(F.col("p_repeat") - F.col("fitted")) <= 1e-9).alias("as_fitted"),
                F.col("p_repeat").between(0, 1).alias("is_probability"),
            )
            out = one if out is None else out.unionByName(one)
        return show(out)

    def clusters_by_table(spark, d):
        """Nearest centre of every customer from the table of centres, against the fitted pipeline."""
        feats = stage_table(features_now(spark, d), "features")
        done = clusters.cluster(feats, CONFIG, CONFIG.ks[0])
        prepared = done.model.transform(feats)
        scale = done.model.stages[-2]
        table = model_tables.center_table(
            spark, done.centers, scale.mean.toArray(), scale.std.toArray(), clusters.FEATURES)
        inputs = F.array(*[F.col(f"z_{c}") for c in clusters.FEATURES])
        rows = prepared.select("customer_unique_id", F.col("cluster").alias("fitted"), *[f"z_{c}" for c in clusters.FEATURES])
        scored = model_tables.nearest_center(rows, table, inputs)
        return show(scored.select(
            "customer_unique_id", (F.col("cluster") == F.col("fitted")).alias("as_fitted"),
            F.col("cluster").between(0, CONFIG.ks[0] - 1).alias("is_cluster"),
        ))

    def hypotheticals(spark, d):
        feats = features_now(spark, d)
        return feats.where(F.col("monetary") > 0).select("customer_unique_id", "recency_days", "frequency", "monetary")

    def whatif_features(spark, d):
        df = propensity.hypothetical_features(hypotheticals(spark, d), CONFIG)
        return show(df.select(
            "customer_unique_id", "recency_days", "frequency", "monetary", "tenure_days", "avg_order_value",
            "n_categories", "freight_ratio", "avg_review", "credit_card_share", "is_sp",
        ))

    def whatif_scores(spark, d):
        _, done = trained(spark, d)
        return show(propensity.score_hypotheticals(done.model, hypotheticals(spark, d), CONFIG, done.best), 6)

    def scored(spark, d):
        return propensity.with_risk_band(_fixed_score(features_now(spark, d)))

    def valued(spark, d):
        w = star(spark, d).staged("fact_orders")
        cut = propensity.train_cutoffs(propensity.test_cutoff(w.fact_orders, CONFIG), CONFIG)[-1]
        rate = clv.orders_per_repeater(w.fact_orders, cut, CONFIG).scalar()
        return clv.clv(propensity.with_risk_band(_fixed_score(
            features.customer_features(w.fact_orders, CONFIG))), rate, CONFIG)

    def orders_per_repeater(spark, d):
        cut = F.date_sub(F.lit(TEST_CUTOFF), CONFIG.window_days)
        return show(clv.orders_per_repeater(star(spark, d).fact_orders, cut, CONFIG))

    def risk_bands(spark, d):
        return show(scored(spark, d).select(
            "customer_unique_id", "customer_state", "recency_days", "frequency", "monetary", "avg_order_value",
            "p_repeat", "churn_risk", "risk_band",
        ))

    def fixed_clusters(feats):
        # a fixed assignment in place of fitted clusters
        return feats.withColumn("cluster", (F.col("customer_unique_id") % 5).cast("int"))

    def cluster_profile(spark, d):
        given = fixed_clusters(features_now(spark, d))
        return show(clusters.named_profile(clusters.profile_of(given)), 4)

    def master(spark, d):
        base = valued(spark, d)
        scores = rfm.rfm(base).select("customer_unique_id", "R", "F", "M", "rfm_score", "segment")
        given = fixed_clusters(base)
        names = clusters.named_profile(clusters.profile_of(given)).select("cluster", "cluster_name")
        joined = given.join(scores, "customer_unique_id").join(F.broadcast(names), "cluster")  # five names
        return stage_table(joined, "master")

    def on_master(fn, digits=None, only=()):
        return lambda spark, d: show(fn(master(spark, d)), digits, only)

    def crosstab(m):
        return insights.segment_cluster_crosstab(m, rfm.SEGMENT_ORDER)

    def customer_lookup(spark, d):
        m = master(spark, d)
        # the customer of the largest value, by id
        best = m.orderBy(F.desc("monetary"), "customer_unique_id").first()
        found = serving.customer_by_id(m, best["customer_unique_id"] if best else None)
        return show(found.select("customer_unique_id", "frequency", "monetary", "segment", "clv_tier"), 4, ("monetary",))

    wanted = (["At Risk", "Loyal", "Lost"], ["very high", "high", "low"])

    def k_scores(spark, d):
        return once(spark, d, "k", lambda: clusters.choose_k(features_now(spark, d), CONFIG))

    def kmeans_clusters(spark, d):
        return show(clusters.cluster(features_now(spark, d), CONFIG, clusters.best_k(k_scores(spark, d))).assigned)

    def choose_k(spark, d):
        return show(k_scores(spark, d), 6)

    def affinity_of(level, least, support=0.0):
        return lambda spark, d: affinity.category_affinity(star(spark, d).fact_order_items, level, least, support)

    def affinity_top(spark, d):
        rules = affinity_of("customer", CONFIG.min_pair_count)(spark, d)
        return insights.first_rows(rules, [F.desc("lift"), F.desc("pair_count"), "antecedent", "consequent"], 20)

    def export_records(spark, d):
        df = features_now(spark, d).select(
            "customer_unique_id", "snapshot", "last_order", "avg_order_value", "customer_state"
        )
        return tables.json_safe(df)

    def customers_master(spark, d):
        return show(customers.build(star(spark, d), CONFIG, clusters.best_k(k_scores(spark, d))).customers, 6)

    return {
        "customer_features": lambda spark, d: show(features_now(spark, d)),
        "customer_features_asof": customer_features_asof,
        "customer_features_by_state": customer_features_by_state,
        "main_category": main_category,
        "rfm_scores": lambda spark, d: show(rfm.rfm(features_now(spark, d))),
        "segment_summary": lambda spark, d: show(_rounded(
            rfm.segment_summary(rfm.rfm(features_now(spark, d))),
            {"avg_monetary": 4, "revenue": 4, "share_customers": 9, "share_revenue": 9},
        )),
        "churn_labels": churn_labels,
        "churn_metrics_eval": lambda spark, d: show(propensity.binary_metrics(judged(spark, d)), 6),
        "score_calibration": lambda spark, d: show(insights.score_calibration(judged(spark, d)), 9),
        "churn_train": churn_train,
        "churn_importance": churn_importance,
        "churn_scores": churn_scores,
        "churn_by_tables": churn_by_tables,
        "clusters_by_table": clusters_by_table,
        "risk_bands": risk_bands,
        "score_percentile": lambda spark, d: show(
            propensity.score_percentile(_fixed_score(features_now(spark, d)), 0.01)
        ),
        "whatif_features": whatif_features,
        "whatif_scores": whatif_scores,
        "orders_per_repeater": orders_per_repeater,
        "clv": lambda spark, d: show(valued(spark, d).select(
            "customer_unique_id", "avg_order_value", "p_repeat", "risk_band", "expected_orders_12m", "clv_12m",
            "clv_tier",
        )),
        "clv_share_by_tier": lambda spark, d: show(_rounded(
            insights.clv_share_by_tier(valued(spark, d)), {"total_clv": 4, "share_clv": 9}
        )),
        "repeat_by_frequency": lambda spark, d: show(
            insights.repeat_by_frequency(_fixed_score(features_now(spark, d))), 9
        ),
        "kmeans_clusters": kmeans_clusters,
        "choose_k": choose_k,
        "cluster_profile": cluster_profile,
        "affinity_order": affinity_of("order", CONFIG.min_pair_count, 0.0215),
        "affinity_customer": affinity_of("customer", CONFIG.min_pair_count, 0.18),
        "affinity_order_all": affinity_of("order", CONFIG.min_pair_count),
        "affinity_customer_all": affinity_of("customer", CONFIG.min_pair_count),
        "affinity_top": affinity_top,
        "clv_by_segment": lambda spark, d: show(_rounded(
            insights.clv_by_segment(master(spark, d)), {"avg_clv": 4, "total_clv": 4, "p_repeat": 9}
        )),
        "rm_matrix": on_master(insights.rm_matrix, clv_digits),
        "segment_cluster_crosstab": on_master(crosstab),
        "customer_list": on_master(lambda m: serving.customer_list(m, segment="Champions", limit=1000)),
        "target_list": on_master(lambda m: serving.target_list(m, *wanted, sort_by="recency_days", limit=500)),
        "target_export": on_master(lambda m: serving.target_list(m, *wanted, sort_by="recency_days")),
        "customer_lookup": customer_lookup,
        "target_summary": lambda spark, d: show(_rounded(
            serving.target_summary(master(spark, d), *wanted), {"expected_clv": 4, "expected_repeaters": 6}
        )),
        "export_records": export_records,
        "customers_master": customers_master,
    }


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def all_queries() -> dict[str, Query]:
    return {**_warehouse_queries(), **_report_queries(), **_demand_queries(), **_customer_queries()}


def all_oracles() -> dict[str, str]:
    from tallymart.plans.oracle_models import MODELS
    from tallymart.plans.oracle_reports import REPORTS

    return {**REPORTS, **MODELS}
