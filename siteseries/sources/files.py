"""CSV and Parquet sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from siteseries.functions.numeric import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, ISO dates and NA for null, under a declared schema (no inference pass)."""
    df = (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
          .option("dateFormat", "yyyy-MM-dd").csv(path))
    return nan_to_null(df)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header and NA for null. `single_file` is for small report tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_tables(tables: dict[str, DataFrame], folder: str, single_file: bool = False) -> list[str]:
    """Write each named table below one folder."""
    paths = []
    for name, df in tables.items():
        path = os.path.join(folder, name)
        write_csv(df, path, single_file)
        paths.append(path)
    return paths


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table to Parquet and continue from it: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
