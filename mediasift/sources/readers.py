"""Tables by name from files, and protocols for platform inputs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

VALUE = StructType([StructField("label", StringType()), StructField("value", StringType()), StructField("normalized", StringType())])
CONTACT = StructType([StructField("id", StringType()), StructField("given", StringType()), StructField("family", StringType()), StructField("organization", StringType()), StructField("phones", ArrayType(VALUE)), StructField("emails", ArrayType(VALUE)), StructField("store_id", StringType()), StructField("updated", TimestampNTZType())])
ASSET = StructType(
    [StructField("id", StringType()), StructField("media_type", StringType()), StructField("subtype_mask", LongType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("created", TimestampNTZType()), StructField("modified", TimestampNTZType()), StructField("duration", DoubleType())]
    + [StructField("is_favorite", BooleanType()), StructField("is_hidden", BooleanType()), StructField("source_mask", LongType()), StructField("has_adjustments", BooleanType()), StructField("represents_burst", BooleanType()), StructField("burst_id", StringType()), StructField("size_bytes", LongType())]
)


class Reader(Protocol):
    """Anything that gives a catalog or an address book as a DataFrame."""

    def read(self, spark: SparkSession) -> DataFrame: ...


class Fingerprinter(Protocol):
    """Turns content into a digest column."""

    def digest(self, content: Column) -> Column: ...


class FileReader:
    """Parquet, ORC, JSON or CSV files with a known schema; nothing is inferred from the data."""

    def __init__(self, path: str, schema: StructType, format: str = "parquet"):
        self.path, self.schema, self.format = path, schema, format

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).schema(self.schema).load(self.path)


def content_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of files; a query that only needs lengths reads no content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
