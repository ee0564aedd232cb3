"""Typed scan of the nine source tables from CSV files with a header."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.schemas import OPTIONAL, SOURCES

# Only free text may span lines. A file read with multiLine cannot be split, so other tables go without it.
MULTILINE = ("reviews",)


def load_table(spark: SparkSession, name: str, folder: str, files: Mapping[str, str] | None = None) -> DataFrame:
    """One table, with columns matched by header name and values that do not parse as null.

    `files` maps table names to file names or globs below `folder`; the default is `<name>.csv`. A byte order
    mark is dropped and zip prefixes stay text.
    """
    if name not in SOURCES:
        raise ValueError(f"unknown table '{name}'; options: {', '.join(SOURCES)}")
    path = f"{folder}/{(files or {}).get(name, f'{name}.csv')}"
    raw = (
        spark.read.option("header", True)
        .option("multiLine", name in MULTILINE)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    typed = [c.split(" ", 1) for c in SOURCES[name].split(", ")]
    return raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in typed])


def load_all(
    spark: SparkSession, folder: str, include_geo: bool = False, files: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """All tables, lazily. The geolocation table is read only when asked for."""
    names = [n for n in SOURCES if include_geo or n not in OPTIONAL]
    return {n: load_table(spark, n, folder, files) for n in names}
