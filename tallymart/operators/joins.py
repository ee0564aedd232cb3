"""Equi-joins of a large table with a table that is unique on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def many_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join `many` to `one` (unique on `key`), `how` being "left" or "inner".

    One plan at every size: each side is scanned once. Spark broadcasts `one` when its own size check allows, else
    both sides are shuffled, and adaptive execution splits the partitions of hot keys (`session.build_session` makes
    it do so even where that costs another exchange).
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type '{how}'")
    return many.join(one, key, how)
