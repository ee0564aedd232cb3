"""Job parameters. Paths are job arguments and do not live here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# The label of the all-categories series, the label of an unmapped category.
TOTAL = "__total__"
UNKNOWN = "unknown"

# Categories that get a one-hot column in the propensity features.
REPEAT_CATEGORIES = (
    "bed_bath_table", "furniture_decor", "health_beauty", "sports_leisure", "housewares",
    "computers_accessories", "watches_gifts", "telephony", "garden_tools", "auto", "toys", "perfumery",
)


@dataclass(frozen=True)
class Config:
    # analysis window, both days inclusive
    start: date = date(2017, 1, 1)
    end: date = date(2018, 8, 19)
    kept_status: str = "delivered"

    # demand panel and forecasts
    horizon: int = 8
    n_folds: int = 3
    top_n: int = 15
    season: int = 52

    # boosted trees over all series
    gbt_rounds: int = 60
    gbt_step: float = 0.1
    gbt_depth: int = 4

    # repeat purchase
    window_days: int = 180
    train_cutoffs: int = 4
    step_days: int = 30
    card_type: str = "credit_card"
    home_states: tuple[str, ...] = ("SP",)
    neighbour_states: tuple[str, ...] = ("RJ", "MG")
    repeat_categories: tuple[str, ...] = REPEAT_CATEGORIES
    classifier_rounds: int = 60

    # clusters
    ks: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    kmeans_restarts: int = 10

    clv_days: int = 365
    margin: float = 1.0
    min_pair_count: int = 5
    seed: int = 42
