"""The forecasting stage: panel, backtest, leaderboards and the final forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.operators import boosted, demand, evaluation, forecasting
from tallymart.session import stage_table


@dataclass(frozen=True)
class ForecastStage:
    demand_weekly: DataFrame
    forecast_backtest: DataFrame
    forecast_leaderboard: DataFrame
    forecast_leaderboard_by_series: DataFrame
    forecast: DataFrame
    forecast_feature_importance: DataFrame
    model: PipelineModel


def build(items: DataFrame, config: Config, holidays: DataFrame | None = None) -> ForecastStage:
    """All models on all folds in one pass; fold 0 is the forecast past the history."""
    panel = stage_table(demand.weekly_demand(items, config.top_n), "panel")
    models: dict[int, PipelineModel] = {}

    def trees(p, horizon, folds):
        return boosted.boosted_forecasts(p, horizon, folds, config, holidays, models)

    every = stage_table(
        forecasting.forecast_all(panel, config.horizon, range(config.n_folds + 1), boosted=trees), "forecasts"
    )
    past = every.where(F.col("fold") > 0).join(panel, ["series", "week"])
    tested = stage_table(past.select(*forecasting.COLUMNS, "y"), "backtest")
    return ForecastStage(
        demand_weekly=panel,
        forecast_backtest=tested,
        forecast_leaderboard=evaluation.leaderboard(tested),
        forecast_leaderboard_by_series=evaluation.leaderboard(tested, ["series", "model"]),
        forecast=evaluation.final_forecast(every.where(F.col("fold") == 0), tested),
        forecast_feature_importance=boosted.feature_importance(models[0]),
        model=models[0],
    )
