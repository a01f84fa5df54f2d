"""The stages that look at one row at a time, over streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.functions import derive
from derivia.functions.rules import Rule, coerce_rule, resolve_order
from derivia.operators.noise import NoiseOp, corrupted


def with_ids(stream: DataFrame, key: Column, ids: Mapping[str, tuple[str, int]], seed: int | str) -> DataFrame:
    """Identifiers {column: (tag, digits)} of a key, the same as a batch run derives."""
    return stream.withColumns({c: derive.derive_id(key, seed, tag, digits=digits) for c, (tag, digits) in ids.items()})


def with_columns(stream: DataFrame, key: str, rules: Mapping[str, Any], seed: int | str, table: str) -> DataFrame:
    """Columns by rules, keyed on a column of row keys."""
    ruled: dict[str, Rule] = {k: coerce_rule(v) for k, v in rules.items()}
    for name in resolve_order(ruled, stream.columns):
        stream = ruled[name].attach(stream, name, key, seed, f"table\0{table}\0{name}")
    return stream


def with_noise(stream: DataFrame, key: str, ops: Mapping[str, Sequence[NoiseOp]], seed: int | str, table: str) -> DataFrame:
    """Corruption of columns, keyed on a column of row keys; batches and streams corrupt the same rows alike."""
    for column, each in ops.items():
        for op in each:
            stream, _ = corrupted(stream, column, op, seed, f"noise\0{table}\0{column}\0{op.name}", key)
    return stream


def run_available(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append what a source holds now to Parquet, exactly once for a checkpoint folder."""
    query = prepare(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def row_key(entity: str, index: str) -> Column:
    """The key of an entity by its index column."""
    return F.concat(F.lit(f"{entity}:"), F.col(index).cast("string"))
