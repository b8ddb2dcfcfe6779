"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteseries.session import scratch_path
from siteseries.sources.files import stage

#: White space of every contract: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: A table of keys is broadcast up to this many counted rows (at most 64 bytes each); past it the join shuffles.
BROADCAST_ROWS = 500_000


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from it: a lost executor costs a re-read only."""
    return stage(df, scratch_path(df.sparkSession, name))


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def id_text(name: str) -> Column:
    """An id as text, for pandas functions: pandas would turn whole numbers beside nulls into inexact ones."""
    return F.col(f"`{name}`").cast("string").alias("doc_id")


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that internal columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def sized(keys: DataFrame) -> DataFrame:
    """A written key table, broadcast only when its counted rows are within the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine; queries pass it on as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
