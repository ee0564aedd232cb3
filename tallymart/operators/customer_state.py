"""Customer features from stored months: what the orders of a month add to a customer is computed once.

The state holds one row per (month, customer) with minima, maxima, sums and counts. They merge in any order, so the
features of any day are the merged months before its own, and the orders of its own month up to that day. A load of new
orders aggregates only the months that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.config import Config
from tallymart.operators.features import filled_features, merge_partials, order_partials, raw_features
from tallymart.operators.months import BOUGHT, MONTH, bought_between
from tallymart.session import stage_table
from tallymart.sources.tables import MissingTable, read_table

KEY = "customer_unique_id"


def _by_month(facts: DataFrame) -> DataFrame:
    facts = facts if MONTH in facts.columns else facts.withColumn(MONTH, F.trunc(F.col(BOUGHT).cast("date"), "month"))
    return facts.where(F.col(MONTH).isNotNull())


def stored(facts: DataFrame, folder: str) -> DataFrame | None:
    """The state, None before the first update."""
    parent, name = folder.rstrip("/").rsplit("/", 1)
    try:
        return read_table(facts.sparkSession, parent, name)
    except MissingTable:
        return None


def changed_months(facts: DataFrame, folder: str) -> list[date]:
    """Months whose number of orders is not that of the state, in order: new months, late and withdrawn orders.

    Of facts stored by month this reads only row counts. Orders that were corrected in place leave the count as it
    is; name their months in `update`.
    """
    have = _by_month(facts).groupBy(MONTH).agg(F.count("order_id").alias("n"))
    state = stored(facts, folder)
    if state is None:
        found = have
    else:
        known = state.groupBy(MONTH).agg(F.sum("frequency").alias("_known"))
        found = have.join(known, MONTH, "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("_known", F.lit(0)))
    return [r[0] for r in found.select(MONTH).orderBy(MONTH).collect()]  # one row per month


def update(facts: DataFrame, folder: str, config: Config, corrected: Sequence[date] = (), every: bool = False) -> list[date]:
    """Bring the state in `folder` up to date with the facts and return the months that were aggregated.

    These are the changed months, those named in `corrected` (any day of the month) and, with `every`, all. Each
    replaces the month's folder, so an update can be repeated. Orders without a time are in no month; those without
    a customer are one row of their month. A month whose orders are all gone keeps one empty row.
    """
    spark = facts.sparkSession
    dated = _by_month(facts)
    redo = {d.replace(day=1) for d in corrected} | set(changed_months(facts, folder))
    if every:
        redo |= {r[0] for r in dated.select(MONTH).distinct().collect()}
        old = stored(facts, folder)
        redo |= {r[0] for r in old.select(MONTH).distinct().collect()} if old is not None else set()
    if not redo:
        return []
    named = sorted(redo)
    parts = order_partials(dated.where(F.col(MONTH).isin(named)), [MONTH, KEY], config)
    # one empty row for every month: it says that the month was made
    made = spark.createDataFrame([(m,) for m in named], f"{MONTH} date").withColumn("frequency", F.lit(0).cast("bigint"))
    rows = parts.unionByName(made, allowMissingColumns=True).hint("rebalance", MONTH)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH).parquet(folder)
    return named


def features(facts: DataFrame, folder: str, days: Sequence[date], config: Config) -> DataFrame:
    """`customer_features` at the given days, from the state and the orders of the days' own months before them.

    The state has to be up to date for the months before the last day's. Of facts stored by month only the folders
    of the days' own months are read, and none for the first day of a month.
    """
    state = stored(facts, folder)
    if state is None:
        raise MissingTable(f"no customer state in {folder}; update it first")
    ordered = sorted(set(days))
    if not ordered:
        raise ValueError("name at least one day")
    firsts = [d.replace(day=1) for d in ordered]
    all_days = F.array(*[F.lit(d) for d in ordered])

    # a month is merged once per interval between snapshots, and that for every later snapshot
    later = state.where((F.col(MONTH) < firsts[-1]) & F.col(KEY).isNotNull())
    passed = sum((F.when(F.col(MONTH) >= m, 1).otherwise(0) for m in firsts), F.lit(0))
    merged = merge_partials(later.withColumn("_interval", passed), ["_interval", KEY])
    whole = merged.withColumn(
        "snapshot", F.explode(F.slice(all_days, F.col("_interval") + 1, len(ordered)))).drop("_interval")

    begun = [(d, m) for d, m in zip(ordered, firsts, strict=True) if d > m]
    parts = whole
    for own, inside in _grouped(begun).items():
        some = bought_between(facts, F.lit(own), F.lit(inside[-1])).where(F.col(KEY).isNotNull())
        seen = F.filter(F.array(*[F.lit(d) for d in inside]), lambda d: F.col(BOUGHT) < d.cast("timestamp_ntz"))
        dated = some.withColumn("snapshot", F.explode(seen))
        parts = parts.unionByName(order_partials(dated, ["snapshot", KEY], config))
    keys = ["snapshot", KEY]
    merged = merge_partials(parts, keys)
    return filled_features(stage_table(raw_features(merged, keys), "customer_features"))


def _grouped(begun: list[tuple[date, date]]) -> dict[date, list[date]]:
    out: dict[date, list[date]] = {}
    for day, month in begun:
        out.setdefault(month, []).append(day)
    return out
