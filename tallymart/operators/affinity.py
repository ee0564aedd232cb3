"""Category affinity: which categories are bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.config import UNKNOWN
from tallymart.session import stage_table

COLUMNS = ("antecedent", "consequent", "pair_count", "support", "confidence", "lift")
LEVELS = {"order": "order_id", "customer": "customer_unique_id"}


def basket_sets(items: DataFrame, level: str) -> DataFrame:
    """Distinct category sets and the number of baskets that hold exactly that set.

    The set of one basket is bounded by the category list and is built map-side, so a basket with very many
    items sends few rows. Equal sets are then counted, so pairs are formed once per set and not per basket.
    """
    key = LEVELS[level]
    known = items.where((F.col("category") != UNKNOWN) & F.col(key).isNotNull())
    baskets = known.groupBy(key).agg(F.sort_array(F.collect_set("category")).alias("cats"))
    return baskets.groupBy("cats").agg(F.count(F.lit(1)).alias("baskets"))


def category_affinity(
    items: DataFrame, level: str = "order", min_pair_count: int = 5, min_support: float = 0.0
) -> DataFrame:
    """Rules A -> B with support, confidence and lift, highest lift first. Runs one job when called.

    A pair needs both the count and the share of all baskets.
    """
    sets = stage_table(basket_sets(items, level), "basket_sets")  # read three times below
    n = sets.agg(F.sum("baskets")).scalar()
    single = sets.select(F.explode("cats").alias("category"), "baskets").groupBy("category").agg(
        F.sum("baskets").alias("in_baskets")
    )
    # both orders of a pair have the same count: form one of them, mirror the counted pairs
    # a pair is one category of a set with one that comes after it in the sorted set
    half = (
        sets.select("cats", "baskets", F.posexplode("cats").alias("at", "a"))
        .select("a", "baskets", F.explode(F.expr("slice(cats, at + 2, size(cats))")).alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("baskets").alias("pair_count"))
        .where((F.col("pair_count") >= min_pair_count) & (F.col("pair_count") >= n * F.lit(min_support)))
    )
    sides = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                    F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    pairs = half.select(F.explode(sides).alias("s"), "pair_count").select(
        F.col("s.x").alias("antecedent"), F.col("s.y").alias("consequent"), "pair_count"
    )
    left = single.select(F.col("category").alias("antecedent"), F.col("in_baskets").alias("_a"))
    right = single.select(F.col("category").alias("consequent"), F.col("in_baskets").alias("_b"))
    rules = pairs.join(left, "antecedent").join(right, "consequent").withColumn("_n", n)
    pair, whole = F.col("pair_count"), F.col("_n")
    rules = rules.withColumns({"support": pair / whole, "confidence": pair / F.col("_a")})
    rules = rules.withColumn("lift", F.col("confidence") / (F.col("_b") / whole))
    return rules.select(*COLUMNS).orderBy(
        F.desc("lift"), F.desc("pair_count"), "antecedent", "consequent"
    )
