"""Stored tables: parquet, JSON and CSV sinks and sources, and fitted models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StructType, TimestampNTZType, TimestampType


class MissingTable(LookupError):
    """The named table or model has not been written yet."""


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """Write each frame as parquet under its name. `partition_by` maps a table to a partition column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        raise _missing(e, folder, name) from e


def write_json(df: DataFrame, folder: str, name: str) -> None:
    """JSON lines in the record form of `json_safe`."""
    json_safe(df).write.mode("overwrite").json(f"{folder}/{name}")


def read_json(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).json(f"{folder}/{name}")
    except AnalysisException as e:
        raise _missing(e, folder, name) from e


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_model(model: PipelineModel, folder: str, name: str) -> None:
    model.write().overwrite().save(f"{folder}/{name}")


def read_model(folder: str, name: str) -> PipelineModel:
    try:
        return PipelineModel.load(f"{folder}/{name}")
    except Exception as e:
        if "does not exist" in str(e):
            raise MissingTable(f"'{name}' is missing in {folder}; run its stage first") from e
        raise


def json_safe(df: DataFrame) -> DataFrame:
    """Records any JSON reader takes: NaN as null, days and timestamps as yyyy-MM-dd."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("date").cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def _missing(e: AnalysisException, folder: str, name: str) -> Exception:
    if e.getCondition() == "PATH_NOT_FOUND":
        return MissingTable(f"'{name}' is missing in {folder}; run its stage first")
    return e
