"""Forecast errors, leaderboards, intervals and forecast queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymart.config import TOTAL
from tallymart.operators.forecasting import COLUMNS

METRICS = ("mae", "rmse", "wape", "smape", "bias")


def error_metrics() -> list[Column]:
    """Aggregates over columns y and yhat."""
    err = F.col("yhat") - F.col("y")
    size = F.abs("y") + F.abs("yhat")
    actual = F.greatest(F.sum(F.abs("y")), F.lit(1e-9))
    return [
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.sum(F.abs(err)) / actual).alias("wape"),
        F.avg(F.when(size == 0, 0.0).otherwise(F.try_divide(2 * F.abs(err), size))).alias("smape"),
        (F.sum(err) / actual).alias("bias"),
    ]


def leaderboard(backtested: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Errors per group, best first within the leading keys."""
    out = backtested.groupBy(*by).agg(*error_metrics())
    return out.orderBy(*by[:-1], "wape", by[-1])


def error_by_horizon(backtested: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per step ahead and one column of WAPE per model."""
    scored = leaderboard(backtested, ("h", "model"))
    return scored.groupBy("h").pivot("model", list(models)).agg(F.first("wape")).orderBy("h")


def best_models(backtested: DataFrame) -> DataFrame:
    """Model of least WAPE per series; ties go to the first name."""
    scored = backtested.groupBy("series", "model").agg(*error_metrics())
    best = F.min(F.struct("wape", "model"))
    return scored.groupBy("series").agg(best["model"].alias("model"), best["wape"].alias("wape"))


def with_intervals(forecasts: DataFrame, backtested: DataFrame) -> DataFrame:
    """80 % intervals from the relative backtest errors of the same series, model and step."""
    relative = backtested.withColumn("r", (F.col("y") - F.col("yhat")) / F.greatest("yhat", F.lit(1.0)))
    # one value per fold in each group
    spread = relative.groupBy("series", "model", "h").agg(
        F.percentile("r", F.array(F.lit(0.1), F.lit(0.9))).alias("q")
    )
    joined = forecasts.join(spread, ["series", "model", "h"], "left")
    low = F.coalesce(F.get("q", F.lit(0)), F.lit(-0.2))
    high = F.coalesce(F.get("q", F.lit(1)), F.lit(0.2))
    yhat = F.col("yhat")
    return joined.withColumns({
        "lower": F.greatest(F.least(yhat * (1 + low), yhat), F.lit(0.0)),
        "upper": F.greatest(yhat * (1 + high), yhat),
    }).drop("q")


def with_best_flag(forecasts: DataFrame, backtested: DataFrame) -> DataFrame:
    best = best_models(backtested).select("series", F.col("model").alias("_best"))
    joined = forecasts.join(best, "series", "left")
    return joined.withColumn("is_best", F.coalesce(F.col("model") == F.col("_best"), F.lit(False))).drop("_best")


def final_forecast(forecasts: DataFrame, backtested: DataFrame) -> DataFrame:
    """Forecasts past the history with intervals and the flag of each series' best model."""
    out = with_best_flag(with_intervals(forecasts.select(*COLUMNS), backtested), backtested)
    return out.select("series", "week", "model", "yhat", "h", "lower", "upper", "is_best")


def forecast_series(forecast: DataFrame) -> DataFrame:
    return forecast.select("series").distinct().orderBy("series")


def recent_history(panel: DataFrame, weeks: int) -> DataFrame:
    """The last `weeks` rows of each series."""
    latest = Window.partitionBy("series").orderBy(F.desc("week"))
    return panel.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= weeks).drop("_n")


def forecast_lookup(
    forecast: DataFrame,
    panel: DataFrame,
    by_series: DataFrame,
    series: str | None = None,
    model: str = "best",
    horizon: int = 8,
    history_weeks: int = 26,
) -> DataFrame:
    """History and forecast of one series (or of all), with the backtest error of the model.

    Rows carry kind `history` (y) or `forecast` (yhat, lower, upper).
    """
    if horizon < 1 or history_weeks < 0:
        raise ValueError("horizon must be at least 1 and history_weeks at least 0")
    longest = forecast.agg(F.max("h")).first()[0] or horizon
    if horizon > longest:
        raise ValueError(f"the forecast ends at horizon {longest}")
    if series is not None:
        forecast, panel = (df.where(F.col("series") == series) for df in (forecast, panel))
    chosen = forecast.where(F.col("is_best") if model == "best" else F.col("model") == model)
    if series is not None and chosen.isEmpty():
        if forecast.isEmpty():
            raise LookupError(f"unknown series '{series}'")
        raise LookupError(f"unknown model '{model}'")
    error = by_series.select("series", "model", F.col("wape").alias("backtest_wape"))
    ahead = chosen.where(F.col("h") <= horizon).join(error, ["series", "model"], "left").select(
        "series", F.lit("forecast").alias("kind"), "week", F.lit(None).cast("double").alias("y"), "yhat", "lower",
        "upper", "model", F.col("is_best").alias("is_backtest_best"), "backtest_wape",
    )
    nothing = F.lit(None).cast("double")
    past = recent_history(panel, history_weeks).select(
        "series", F.lit("history").alias("kind"), "week", "y", nothing.alias("yhat"), nothing.alias("lower"),
        nothing.alias("upper"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("boolean").alias("is_backtest_best"), nothing.alias("backtest_wape"),
    )
    return past.unionByName(ahead).orderBy("series", "week")


def forecast_growth(forecast: DataFrame, panel: DataFrame, weeks: int = 8) -> DataFrame:
    """Best forecast over the horizon against the last `weeks` weeks, per series without the total."""
    ahead = forecast.where(F.col("is_best") & (F.col("series") != TOTAL)).groupBy("series").agg(
        F.sum("yhat").alias("ahead")
    )
    past = recent_history(panel.where(F.col("series") != TOTAL), weeks).groupBy("series").agg(
        F.sum("y").alias("past")
    )
    joined = ahead.join(past, "series")
    growth = F.try_divide(F.col("ahead"), F.col("past")) - 1
    return joined.withColumn("growth", growth).where(F.col("growth").isNotNull()).orderBy("growth", "series")


def forecast_against_actual(forecast: DataFrame, panel: DataFrame, horizon: int) -> DataFrame:
    """Per series and model: forecast total over the horizon against the last `horizon` actual weeks."""
    ahead = forecast.where(F.col("h") <= horizon).groupBy("series", "model").agg(F.sum("yhat").alias("forecast_total"))
    past = recent_history(panel, horizon).groupBy("series").agg(F.sum("y").alias("actual_total"))
    change = F.col("forecast_total") / F.greatest("actual_total", F.lit(1.0)) - 1
    return ahead.join(past, "series").withColumn("change", change)
