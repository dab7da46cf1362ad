"""Readers and writers, with explicit schemas where the format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FORMATS = ("parquet", "orc", "csv", "json", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A file or folder as a DataFrame; CSV and JSON want a schema, as inferring one reads all data twice."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**({"header": True} if format == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    writer = df.write.format(format).mode(mode).options(**({"header": True} if format == "csv" else {}), **options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties) -> DataFrame:
    """A table over JDBC, read in ranges of a column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()
