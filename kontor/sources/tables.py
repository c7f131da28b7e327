"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kontor.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: one Parquet file or a folder of them; filters and columns are pushed down."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
