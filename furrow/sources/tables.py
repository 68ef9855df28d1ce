"""Typed readers and writers for CSV, parquet and JDBC tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.checks import nan_to_null
from furrow.schemas import FARM_RECORD


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Header CSV. Give a schema: inferring one costs an extra scan of all files."""
    reader = spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return nan_to_null(reader.schema(schema).csv(path))


def read_farm_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = FARM_RECORD) -> DataFrame:
    """Farm records with dates parsed and the pest flag repaired from 0/1 or text."""
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.BooleanType) else f for f in schema.fields]
    )
    flags = [f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)]
    return read_csv(spark, path, as_text).withColumns({c: F.col(c).try_cast("boolean") for c in flags})


def load_sample(
    spark: SparkSession, path: str | None, n_rows: int = 100_000, schema: T.StructType | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """The first rows of a CSV file, for looking around; with ``order`` the same ones on every run."""
    if not path:
        raise ValueError("a path to a CSV file is needed")
    rows = read_csv(spark, path, schema)
    return (rows.orderBy(*order) if order else rows).limit(n_rows)


def rows_to_table(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType) -> DataFrame:
    """Requests given as dictionaries; fields they lack are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """Operational table read by parallel range queries on a numeric column."""
    low, high = bounds
    return spark.read.jdbc(url, table, column=split_on, lowerBound=low, upperBound=high, numPartitions=parts)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts with headers; Spark creates parent folders."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
