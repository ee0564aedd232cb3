"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.session import scratch_dir

# Letters, digits and everything beyond ASCII: what [^\x00-\x2F\x3A-\x60\x7B-\x7F] means in lower-cased text. The
# positive form lets the regex engine scan about six times as fast.
ALNUM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def alnum_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased. Null has no words."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(ALNUM_WORD), F.lit(0))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch area."""
    return f"{scratch_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch area and read it back: cuts the lineage and survives lost executors.

    With `by` the rows lie in one folder per value of that column, so a filter on it reads only those.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identity(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`_id` and `_text` (null as empty) of each row with join keys that are never null.

    `_no_id`, `_of` and `_hash` are equal only in rows that have the same id and, by its 64-bit hash, the same text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("_id"), body.alias("_text"), F.col(doc_id).isNull().alias("_no_id"),
        F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("_of"), F.xxhash64(body).alias("_hash"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first of `name_`, `name__`, ... that no column of `df` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_keys(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """`docs` with the three keys of `identity` under names that it does not have yet, and those names."""
    who = [free_name(docs, name) for name in ("_no_id", "_of", "_hash")]
    keys = (
        F.col(doc_id).isNull(), F.coalesce(F.col(doc_id), F.lit(0)), F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    )
    return docs.withColumns(dict(zip(who, keys, strict=True))), who
