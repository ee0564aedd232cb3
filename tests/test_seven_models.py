"""The registered backtest and leaderboards of all seven models."""

from __future__ import annotations

import __spark_entry__ as entry

from tallymart.operators.forecasting import ALL_MODELS
from tallymart.plans import registry


def test_backtest_has_every_model_in_every_fold(spark, sf_dir):
    rows = entry.queries()["backtest_seven"](spark, sf_dir).collect()
    folds = range(1, registry.CONFIG.n_folds + 1)
    assert len(ALL_MODELS) == 7
    per = {(r["model"], r["fold"]): 0 for r in rows}
    for r in rows:
        per[r["model"], r["fold"]] += 1
    assert set(per) == {(m, k) for m in ALL_MODELS for k in folds}
    assert len(set(per.values())) == 1 and all(r["yhat"] is not None and r["y"] is not None for r in rows)


def test_leaderboards_of_seven_are_registered():
    names = ["forecast_all", "leaderboard", "leaderboard_by_series", "leaderboard_by_horizon", "best_models", "forecast_lookup"]
    assert {f"{n}_seven" for n in names} <= set(entry.queries())
