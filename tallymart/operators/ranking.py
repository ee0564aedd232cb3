"""Exact ranks, cuts, running totals and medians over data of any size.

A window without partition keys would move every row into one task. Here the rows are range-partitioned on
the sort keys, sorted inside each partition and written once; a row's global position is then its position
in the partition plus the number of rows in earlier partitions. Only one row per partition is broadcast.
The sort keys must end in a unique column, which also keeps the ranges even when one value is very common.
Rows at given ranks need no sort: a sketch brackets them, and only what lies in the brackets is counted by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType
from pyspark.sql.window import Window

from tallymart.session import stage_table

# monotonically_increasing_id() is (partition << 33) + position in the partition
_SHIFT = 33
# The quantile sketch misses a rank by at most a share of 1 / SKETCH_ACCURACY of the rows.
SKETCH_ACCURACY = 10_000
# Rows that a single task may order.
ROWS_IN_ONE_TASK = 1_000_000


def _positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return stage_table(placed, name)


def _part() -> Column:
    return F.shiftright("_at", _SHIFT)


def _offsets(placed: DataFrame, sums: Sequence[str]) -> DataFrame:
    """One row per range partition with the totals of the partitions before it."""
    parts = placed.groupBy(_part().alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = {"_rows": "_rows_before", **{f"_sum_{c}": f"_{c}_before" for c in sums}}
    return parts.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in totals.items()]
    )


def with_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the total order `order`. Runs one job when called."""
    placed = _positions(df, order, "rank")
    out = placed.join(F.broadcast(_offsets(placed, [])), _part() == F.col("_part"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return out.select(*df.columns, (F.col("_rows_before") + inside + 1).alias(rank))


def with_running_totals(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add running totals along `order`: `sums` maps a column to the name of its total."""
    placed = _positions(df, order, "totals").withColumn("_part", _part())
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(_offsets(placed.drop("_part"), list(sums))), "_part")
    return out.select(
        *df.columns, *[(F.sum(c).over(here) + F.col(f"_{c}_before")).alias(n) for c, n in sums.items()]
    )


def _sort_key(name: str, kind: DataType) -> Column:
    """A double that never decreases along the order of the column; one value where a kind has no such number."""
    c = F.col(name)
    if isinstance(kind, NumericType):
        number = F.nanvl(c.cast("double"), F.lit(math.inf))  # NaN sorts last
    elif isinstance(kind, StringType):
        # the first six bytes as a whole number
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
        number = F.conv(head, 16, 10).cast("double")
    else:
        number = F.lit(0.0)
    return F.when(c.isNull(), -math.inf).otherwise(number)  # nulls sort first


def _brackets(df: DataFrame, key: Column, ranks: Sequence[int], n: int) -> list[tuple[float, float]]:
    """Disjoint ascending ranges of `key` that should hold the `ranks`, from one mergeable quantile sketch."""
    slack = 2.0 / SKETCH_ACCURACY
    at = [(r - 0.5) / n for r in ranks]
    asked = [min(max(x + d, 0.0), 1.0) for x in at for d in (-slack, slack)]
    found = df.agg(F.percentile_approx(key, asked, SKETCH_ACCURACY)).first()[0]
    merged: list[tuple[float, float]] = []
    for low, high in sorted(zip(found[::2], found[1::2], strict=True)):
        if merged and low <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def _values_at(df: DataFrame, name: str, ranks: Sequence[int], n: int) -> list[tuple[object, int, int]]:
    """The value of column `name` at each 1-based rank, the rows before that value, and the rows with it.

    A sketch brackets the ranks. One aggregation counts the rows between the brackets, one group each, and the
    rows of each distinct value inside; only these counts are sorted. Should a rank lie outside its bracket,
    everything counts as inside.
    """
    key = _sort_key(name, df.schema[name].dataType)
    for ranges in (_brackets(df, key, ranks, n), [(-math.inf, math.inf)]):
        steps = [step for low, high in ranges for step in (key >= F.lit(low), key > F.lit(high))]
        slot = sum((s.cast("int") for s in steps), F.lit(0))  # odd inside a bracket
        groups = df.select(slot.alias("slot"), F.col(name).alias("v")).groupBy(
            "slot", F.when(F.col("slot") % 2 == 1, F.col("v")).alias("v")
        ).agg(F.count(F.lit(1)).alias("n"))
        run = with_running_totals(groups, [F.col("slot"), F.col("v")], {"n": "upto"})
        before = F.col("upto") - F.col("n")
        asked = F.array(*[F.lit(r).cast("bigint") for r in ranks])
        hits = run.where(F.exists(asked, lambda r: (r > before) & (r <= F.col("upto")))).collect()  # one a rank
        if all(h["slot"] % 2 == 1 for h in hits):
            break
    spans = [(h["v"], h["upto"] - h["n"], h["n"]) for h in hits]
    return [next(s for s in spans if s[1] < r <= s[1] + s[2]) for r in ranks]


def rows_at(pairs: DataFrame, ranks: Sequence[int], n: int) -> list[Row]:
    """The rows of `pairs` (v, t) at the 1-based `ranks` in the order of both columns; n is the number of rows.

    `pairs` is read a few times and should be stored. A sketch of v brackets the ranks, one aggregation counts the
    rows below and inside each bracket, and a task orders the rows of a bracket. Brackets that hold more than
    `ROWS_IN_ONE_TASK`, as where many rows share one v, are counted by value instead.
    """
    key = _sort_key("v", pairs.schema["v"].dataType)
    ranges = _brackets(pairs, key, ranks, n)
    counts = pairs.agg(*[
        F.count_if(c) for low, high in ranges for c in (key < F.lit(low), key.between(F.lit(low), F.lit(high)))
    ]).first()
    held = list(zip(ranges, counts[::2], counts[1::2], strict=True))  # range, rows below it, rows in it
    places: dict[int, tuple[int, int]] = {}  # rank -> number of its bracket, place inside
    for rank in ranks:
        for i, (_, below, inside) in enumerate(held):
            if below < rank <= below + inside <= below + ROWS_IN_ONE_TASK:
                places[rank] = i, rank - below
    out: dict[int, Row] = {}
    if places:
        number = F.coalesce(*[
            F.when(key.between(F.lit(low), F.lit(high)), i)
            for i, ((low, high), _, _) in enumerate(held) if i in {at for at, _ in places.values()}
        ])
        at = _numbered(pairs.withColumn("g", number).where(F.col("g").isNotNull()), list(places.values()))
        out = {rank: at[place] for rank, place in places.items()}
    crowded = [r for r in dict.fromkeys(ranks) if r not in out]
    if crowded:
        out.update(zip(crowded, _crowded_rows_at(pairs, crowded, n), strict=True))
    return [out[r] for r in ranks]


def _numbered(groups: DataFrame, places: Sequence[tuple[int, int]]) -> dict[tuple[int, int], Row]:
    """The (v, t) at each (group, place) of `groups` (g, v, t), whose groups are small."""
    asked = reduce(Column.__or__, [(F.col("g") == g) & (F.col("k") == k) for g, k in places])
    placed = groups.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v", "t")))
    found = placed.where(asked).collect()
    return {(r["g"], r["k"]): Row(v=r["v"], t=r["t"]) for r in found}


def _crowded_rows_at(pairs: DataFrame, ranks: Sequence[int], n: int) -> list[Row]:
    """`rows_at` by counts of equal v. Among the rows of one v, t is bracketed and counted in the same way."""
    kind = pairs.schema["v"].dataType
    out: list[Row | None] = []
    few: dict[int, tuple[int, int]] = {}
    values: list[object] = []
    for rank, (v, before, size) in zip(ranks, _values_at(pairs, "v", ranks, n), strict=True):
        if size <= ROWS_IN_ONE_TASK:
            few[len(out)] = len(values), rank - before
            out.append(None)
        else:
            same = pairs.where(F.col("v").eqNullSafe(F.lit(v).cast(kind)))
            out.append(Row(v=v, t=_values_at(same, "t", [rank - before], size)[0][0]))
        values.append(v)
    if few:
        # a row belongs to the first of equal values
        first = {i: next(j for j, w in enumerate(values) if w is v or w == v) for i, v in enumerate(values)}
        places = {i: (first[at], k) for i, (at, k) in few.items()}
        number = F.coalesce(*[
            F.when(F.col("v").eqNullSafe(F.lit(values[at]).cast(kind)), at)
            for at in sorted({at for at, _ in places.values()})
        ])
        at = _numbered(pairs.withColumn("g", number).where(F.col("g").isNotNull()), list(places.values()))
        for i, place in places.items():
            out[i] = at[place]
    return out


def with_rank_bin(
    df: DataFrame, value: Column, tie: str, cuts: Sequence[Fraction], name: str, descending: bool = False
) -> DataFrame:
    """Add the 1-based bin of each row when its rank by (`value`, `tie`) is cut at the fractions `cuts`.

    With n rows, a row of rank r is in the first bin whose cut q has r <= 1 + (n - 1) q; rows above every
    cut are in the last bin. (value, tie) is written once; the rows at the cuts are found by `rows_at`, and
    each row of `df` compares itself with them, so `df` is neither shuffled nor joined.
    """
    sign = -1 if descending else 1
    pairs = stage_table(df.select((value * sign).alias("v"), F.col(tie).alias("t")), "pairs")
    n = pairs.count()
    if n == 0:
        return df.withColumn(name, F.lit(1).cast("bigint"))
    at = rows_at(pairs, [(n - 1) * q.numerator // q.denominator + 1 for q in cuts], n)
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    me = F.struct((value * sign).cast(kinds["v"]).alias("v"), F.col(tie).alias("t"))
    above = [
        (me > F.struct(F.lit(k["v"]).cast(kinds["v"]).alias("v"), F.lit(k["t"]).cast(kinds["t"]).alias("t")))
        for k in at
    ]
    return df.withColumn(name, sum((a.cast("bigint") for a in above), F.lit(1).cast("bigint")))


def quintile(df: DataFrame, value: Column, tie: str, name: str, descending: bool = False) -> DataFrame:
    return with_rank_bin(df, value, tie, [Fraction(i, 5) for i in range(1, 5)], name, descending)


def medians(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Exact medians of the non-null `values` per `by`: one row per group, columns named as the inputs.

    Equal values are counted first, so what is sorted is one row per distinct value.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])
    long = df.select(F.col(by).alias("g"), F.explode(pairs).alias("p")).select("g", "p.name", "p.x")
    counts = long.where(F.col("x").isNotNull()).groupBy("name", "g", "x").agg(F.count(F.lit(1)).alias("n"))
    run = with_running_totals(counts, [F.col("name"), F.col("g"), F.col("x")], {"n": "upto"})
    groups = run.groupBy("name", "g").agg(F.sum("n").alias("size"), F.min(F.col("upto") - F.col("n")).alias("base"))
    located = run.join(F.broadcast(groups), ["name", "g"])  # one row per (value column, group)
    low, high = F.floor((F.col("size") + 1) / 2), F.floor((F.col("size") + 2) / 2)
    last = F.col("upto") - F.col("base")
    first = last - F.col("n") + 1

    def at(pos: Column) -> Column:
        return F.max(F.when(pos.between(first, last), F.col("x")))

    mid = located.groupBy("g", "name").agg(((at(low) + at(high)) / 2).alias("m"))
    wide = mid.groupBy("g").agg(*[F.max(F.when(F.col("name") == v, F.col("m"))).alias(v) for v in values])
    return wide.withColumnRenamed("g", by)
