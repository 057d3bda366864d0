"""Parquet tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, a file or a folder of parts. A missing
    table raises instead of reading as empty."""
    path = f"{sf_dir}/{name}.parquet"
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
