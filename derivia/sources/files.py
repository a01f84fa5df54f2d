"""Tables from files."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def load_source(spark: SparkSession, source: Any) -> DataFrame:
    """A frame as given (Spark or pandas), or a .csv or .parquet path."""
    if isinstance(source, DataFrame):
        return source
    if hasattr(source, "iloc"):
        return spark.createDataFrame(source)
    path = os.fspath(source)
    suffix = os.path.splitext(path)[1]
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"{path}: a source must be a .csv or .parquet file, got {suffix!r}")
