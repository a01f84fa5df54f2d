"""Checks that a generator or synthesizer plugged in keeps what the built-in ones promise."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.operators.generate import RuleGenerator
from derivia.plans.context import RunContext
from derivia.plans.schema import ENTITY_KEY, RESERVED, ROW_KEY, PerEntity, Schema, Table


class GeneratorConformanceError(AssertionError):
    """A generator breaks a promise."""


class SynthesizerConformanceError(AssertionError):
    """A synthesizer breaks a promise."""


def _target(schema: Schema, table: str | None) -> Table:
    if table is None and len(schema.tables) != 1:
        raise ValueError(f"name the table to check; there are {[t.name for t in schema.tables]}")
    return schema.tables[0] if table is None else schema.table(table)


def _context(schema: Schema, spark: SparkSession, rows: int) -> RunContext:
    return RunContext(spark, schema, rows)


def _differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether a row is in one of the frames more often than in the other; both are read once."""
    if sorted(a.columns) != sorted(b.columns):
        return True
    names = [F.col(f"`{c}`") for c in a.columns]
    both = a.select(*names, F.lit(1).alias("_dv_more")).unionAll(b.select(*names, F.lit(-1).alias("_dv_more")))
    return not both.groupBy(*names).agg(F.sum("_dv_more").alias("_dv_more")).filter("_dv_more <> 0").isEmpty()


#: Tasks for each core that read a table of many small partitions.
TASKS_A_CORE = 4


def _dealt(df: DataFrame, rows: int, partition_rows: int) -> DataFrame:
    """The same partitions, each still computed by itself, several of them by one task: a task for a few rows costs more than they do."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE, -(-rows // partition_rows)))


@contextmanager
def _held(df: DataFrame) -> Iterator[DataFrame]:
    """A frame kept for several reads, and let go whatever they find."""
    df = df.cache()
    try:
        yield df
    finally:
        df.unpersist()


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(RESERVED)]


def check_generator(generator: Any, schema: Schema, *, table: str | None = None, spark: SparkSession | None = None, partition_rows: int = 1_000_000, split_rows: int = 13) -> None:
    """Raise GeneratorConformanceError unless: two runs agree; the keys and declared columns are there, in order; no
    entity's rows are in two partitions; a finer partitioning gives the same rows; a full per-entity table has a row
    for each entity. Raises ValueError where the finer run has one partition only, which would prove nothing.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    target = _target(schema, table)
    with _held(generator.emit(target, _context(schema, spark, partition_rows))) as whole:
        if _differ(whole, generator.emit(target, _context(schema, spark, partition_rows))):
            raise GeneratorConformanceError("determinism: two runs differ")
        missing = [c for c in (ENTITY_KEY, ROW_KEY) if c not in whole.columns]
        if missing:
            raise GeneratorConformanceError(f"columns: the row bookkeeping {missing} is missing")
        want = [c for c in target.output_columns if c not in target.identifiers]
        if _visible(whole) != want:
            raise GeneratorConformanceError(f"columns: emitted {_visible(whole)}, declared {want}")
        n = whole.count()
        split = generator.emit(target, _context(schema, spark, split_rows)).withColumn("_dv_p", F.spark_partition_id())
        with _held(_dealt(split, n, partition_rows)) as placed:
            torn = placed.groupBy(ENTITY_KEY).agg(F.countDistinct("_dv_p").alias("n")).filter("n > 1").head()
            if torn:
                raise GeneratorConformanceError(f"entities: rows of {torn[0]!r} are in {torn[1]} partitions")
            if _differ(whole, placed.drop("_dv_p")):
                raise GeneratorConformanceError("partitions: another partitioning gives other rows")
            if isinstance(target.grain, PerEntity) and target.coverage.value >= 1.0:
                count = schema.entity(target.grain.entity).count.value
                if n != count:
                    raise GeneratorConformanceError(f"rows: {n} rows for {count} entities")
            if placed.select("_dv_p").distinct().count() < 2:
                raise ValueError(f"split_rows={split_rows} leaves one partition with rows; nothing about partitions was checked")


def check_synthesizer(synthesizer: Any, schema: Schema, *, table: str | None = None, spark: SparkSession | None = None, partition_rows: int = 1_000_000, split_rows: int = 13) -> None:
    """Raise SynthesizerConformanceError unless rows and columns survive, columns it doesn't declare stay, two runs
    agree, and a finer partitioning gives the same rows.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    target = _target(schema, table)

    def run(rows: int) -> tuple[DataFrame, DataFrame]:
        ctx = _context(schema, spark, rows)
        base = RuleGenerator().emit(target, ctx)
        return base, synthesizer.run(base, target, ctx)

    base, out = run(partition_rows)
    with _held(out):
        if _differ(out.select(ROW_KEY), base.select(ROW_KEY)):
            raise SynthesizerConformanceError("rows: some are lost, new or doubled")
        if sorted(out.columns) != sorted(base.columns):
            raise SynthesizerConformanceError(f"columns: {sorted(set(out.columns) ^ set(base.columns))} are lost or new")
        declared = set(getattr(synthesizer, "columns", ()) or ())
        if declared:
            kept = [F.col(f"`{c}`") for c in base.columns if c not in declared]
            if _differ(base.select(*kept), out.select(*kept)):
                raise SynthesizerConformanceError("untouched: a column that is not declared changes")
        if _differ(out, run(partition_rows)[1]):
            raise SynthesizerConformanceError("determinism: two runs differ")
        n = out.count()
        finer, split = run(split_rows)
        if _differ(out, _dealt(split, n, partition_rows)):
            raise SynthesizerConformanceError("partitions: another partitioning gives other rows")
        if _dealt(finer.select(F.spark_partition_id().alias("p")), n, partition_rows).distinct().count() < 2:
            raise ValueError(f"split_rows={split_rows} leaves one partition with rows; nothing about partitions was checked")
