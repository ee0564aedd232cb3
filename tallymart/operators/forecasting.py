"""Forecast models over weekly histories.

A history is one row per (fold, series) holding the ordered values as an array: one value per week, so its
length is bounded by the calendar. Every univariate model turns that array into an array of forecasts with
column expressions. All folds, series and models are therefore one narrow projection, without shuffles and
without Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.session import local_parallelism

SEASON = 52
HOLT_MIN_POINTS = 10
ARIMA_MIN_POINTS = 16


def histories(panel: DataFrame, horizon: int, folds: Sequence[int]) -> DataFrame:
    """Values up to each fold's cutoff. Fold k ends k horizons before the last week; fold 0 is everything.

    Folds that would end before the first week have no rows.
    """
    last = panel.agg(F.max("week")).scalar()
    numbered = panel.withColumn("_last", last).withColumn("fold", F.explode(F.array(*[F.lit(k) for k in folds])))
    numbered = numbered.withColumn("cutoff", F.date_sub("_last", F.col("fold") * F.lit(7 * horizon)))
    known = numbered.where(F.col("week") <= F.col("cutoff"))
    grouped = known.groupBy("fold", "cutoff", "series").agg(
        F.sort_array(F.collect_list(F.struct("week", "y"))).alias("points")
    )
    return grouped.select("fold", "cutoff", "series", F.col("points.y").alias("ys"))


def naive(ys: Column, horizon: int) -> Column:
    return F.array_repeat(F.element_at(ys, -1), horizon)


def seasonal_naive(ys: Column, horizon: int, season: int = SEASON) -> Column:
    """The value one season before, cycling; the last value while the history is shorter than a season."""
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    cycled = F.transform(steps, lambda i: F.get(ys, F.size(ys) - season + i % season))
    return F.when(F.size(ys) < season, naive(ys, horizon)).otherwise(cycled)


def moving_average(ys: Column, horizon: int, window: int = 4) -> Column:
    tail = F.slice(ys, F.greatest(F.size(ys) - window + 1, F.lit(1)), window)
    return F.array_repeat(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail), horizon)


# Damped additive trend on `ly`: level l, trend b, squared one-step errors sse; starts at y1 with trend y2 - y1.
_HOLT_FIT = """array_min(transform({grid}, g -> named_struct('s', aggregate(slice(ly, 2, size(ly)),
    named_struct('sse', 0D, 'l', ly[0], 'b', ly[1] - ly[0]),
    (s, y) -> named_struct(
      'sse', s.sse + (y - (s.l + g.p * s.b)) * (y - (s.l + g.p * s.b)),
      'l', g.a * y + (1D - g.a) * (s.l + g.p * s.b),
      'b', g.b * (g.a * y + (1D - g.a) * (s.l + g.p * s.b) - s.l) + (1D - g.b) * (g.p * s.b))),
    'a', g.a, 'b', g.b, 'p', g.p)))"""
_HOLT_COARSE = """flatten(transform(sequence(1, 9), a -> flatten(transform(sequence(0, 4), b ->
    transform(array(0.8D, 0.9D, 0.98D), p -> named_struct('a', a / 10D, 'b', b / 10D, 'p', p))))))"""
# The finer grids lie around the winner `w` of the coarser ones.
_HOLT_FINE = """flatten(transform(sequence(-2, 2), a -> flatten(transform(sequence(-2, 2), b ->
    transform(sequence(-2, 1), p -> named_struct(
      'a', least(greatest(w.a + a / 40D, 0.01D), 0.99D), 'b', least(greatest(w.b + b / 40D, 0D), 0.99D),
      'p', least(greatest(w.p + p / 50D, 0.8D), 0.99D)))))))"""
_HOLT_STEPS = """transform(sequence(1, {horizon}), h -> w.s.l + w.s.b *
    aggregate(sequence(1, h), 0D, (a, k) -> a + power(w.p, k)))"""

# ARIMA(1,1,1) on the differences d of `ly`: error e with e = 0 at the first difference.
_ARIMA_FIT = """array_min(transform({grid}, g -> named_struct('s', aggregate(slice(d, 2, size(d)),
    named_struct('sse', 0D, 'e', 0D, 'x', d[0]),
    (s, x) -> named_struct(
      'sse', s.sse + (x - g.f * s.x - g.t * s.e) * (x - g.f * s.x - g.t * s.e),
      'e', x - g.f * s.x - g.t * s.e,
      'x', x)),
    'f', g.f, 't', g.t)))"""
_ARIMA_AXIS = "concat(array(-0.99D, -0.95D), transform(sequence(-9, 9), i -> i / 10D), array(0.95D, 0.99D))"
_ARIMA_COARSE = f"flatten(transform({_ARIMA_AXIS}, f -> transform({_ARIMA_AXIS}, t -> named_struct('f', f, 't', t))))"
_ARIMA_FINE = """flatten(transform(sequence(-2, 2), f -> transform(sequence(-2, 2), t -> named_struct(
    'f', least(greatest(w.f + f / 50D, -0.99D), 0.99D), 't', least(greatest(w.t + t / 50D, -0.99D), 0.99D)))))"""
_ARIMA_STEPS = """transform(sequence(1, {horizon}), h -> element_at(ly, -1) + (w.f * w.s.x + w.t * w.s.e) *
    aggregate(sequence(1, h), 0D, (a, k) -> a + power(w.f, k - 1)))"""


def _grid_model(df: DataFrame, out: str, horizon: int, fit: str, grids: tuple[str, str], steps: str,
                min_points: int) -> DataFrame:
    """Forecast from the least-squares grid point; equal errors go to the least state, then parameters."""
    kept = df.columns
    df = df.withColumn("ly", F.transform("ys", lambda y: F.log1p(y)))
    df = df.withColumn("d", F.expr("transform(sequence(1, greatest(size(ly) - 1, 1)), i -> ly[i] - ly[i - 1])"))
    enough = F.size("ys") >= min_points
    for grid in grids:
        df = df.withColumn("w", F.when(enough, F.expr(fit.format(grid=grid))))
    logged = F.expr(steps.format(horizon=horizon))
    made = F.transform(logged, lambda x: F.greatest(F.expm1(x), F.lit(0.0)))
    df = df.withColumn(out, F.when(enough, made).otherwise(moving_average(F.col("ys"), horizon)))
    return df.select(*kept, out)


def add_holt_damped(df: DataFrame, out: str, horizon: int) -> DataFrame:
    return _grid_model(df, out, horizon, _HOLT_FIT, (_HOLT_COARSE, _HOLT_FINE), _HOLT_STEPS, HOLT_MIN_POINTS)


def add_arima_111(df: DataFrame, out: str, horizon: int) -> DataFrame:
    return _grid_model(df, out, horizon, _ARIMA_FIT, (_ARIMA_COARSE, _ARIMA_FINE), _ARIMA_STEPS, ARIMA_MIN_POINTS)


def _expression(model: Callable[[Column, int], Column]) -> Callable[[DataFrame, str, int], DataFrame]:
    return lambda df, out, horizon: df.withColumn(out, model(F.col("ys"), horizon))


# Model name to a function that adds an array column of forecasts to the histories. Extend it to plug in a model.
UNIVARIATE: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    "naive": _expression(naive),
    "seasonal_naive": _expression(seasonal_naive),
    "moving_avg_4": _expression(moving_average),
    "ets_damped": add_holt_damped,
    "arima_111": add_arima_111,
}
BOOSTED = "gbt_global"
ENSEMBLE = "ensemble"
ENSEMBLE_MEMBERS = (BOOSTED, "arima_111", "ets_damped")
ALL_MODELS = (*UNIVARIATE, BOOSTED, ENSEMBLE)
COLUMNS = ("fold", "cutoff", "series", "model", "h", "week", "yhat")


def univariate_forecasts(hist: DataFrame, horizon: int, models: Sequence[str]) -> DataFrame:
    """Forecasts of the named univariate models for every history."""
    # few rows with long computations: spread them, as size-based partitioning would put them in one task
    df = hist.repartition(local_parallelism(hist.sparkSession))
    for name in models:
        df = UNIVARIATE[name](df, f"_{name}", horizon)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{m}").alias("yhats")) for m in models])
    df = df.select("fold", "cutoff", "series", F.explode(rows).alias("m"))
    df = df.select("fold", "cutoff", "series", "m.model", F.posexplode("m.yhats").alias("_pos", "yhat"))
    h = F.col("_pos") + 1
    return df.withColumns({"h": h, "week": F.date_add("cutoff", h * 7)}).select(*COLUMNS)


def with_ensemble(forecasts: DataFrame, members: Sequence[str] = ENSEMBLE_MEMBERS) -> DataFrame:
    """Add the mean of the member models; `forecasts` must hold all of them."""
    mixed = (
        forecasts.where(F.col("model").isin(*members))
        .groupBy("fold", "cutoff", "series", "h", "week")
        .agg(F.avg("yhat").alias("yhat"))
        .withColumn("model", F.lit(ENSEMBLE))
    )
    return forecasts.unionByName(mixed)


def forecast_all(
    panel: DataFrame,
    horizon: int,
    folds: Sequence[int] = (0,),
    models: Sequence[str] | None = None,
    boosted: Callable[[DataFrame, int, Sequence[int]], DataFrame] | None = None,
) -> DataFrame:
    """Every model for every series and fold: fold, cutoff, series, model, h, week, yhat.

    `boosted` makes the forecasts of the model over all series and is called only when that model is asked
    for. The ensemble is added when it is asked for and all its members are there.
    """
    models = list(models or ALL_MODELS)
    unknown = set(models) - set(ALL_MODELS) - set(UNIVARIATE)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}; options: {', '.join(ALL_MODELS)}")
    parts = []
    single = [m for m in models if m in UNIVARIATE]
    if single:
        parts.append(univariate_forecasts(histories(panel, horizon, folds), horizon, single))
    if BOOSTED in models:
        if boosted is None:
            from tallymart.operators.boosted import boosted_forecasts as boosted
        parts.append(boosted(panel, horizon, folds).select(*COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if ENSEMBLE in models and set(ENSEMBLE_MEMBERS) <= set(models):
        out = with_ensemble(out)
    return out


def backtest(
    panel: DataFrame, horizon: int = 8, n_folds: int = 3, models: Sequence[str] | None = None, boosted=None
) -> DataFrame:
    """Forecasts of past folds next to the actual values. Fold 1 is the latest, test windows do not overlap."""
    fc = forecast_all(panel, horizon, range(1, n_folds + 1), models, boosted)
    return fc.join(panel, ["series", "week"]).select(*COLUMNS, "y")
