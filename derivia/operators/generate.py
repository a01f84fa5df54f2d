"""Populations, grains and rule-driven columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.functions import derive
from derivia.functions.rules import Rule, period_type, resolve_order
from derivia.plans.context import RunContext
from derivia.plans.registry import register
from derivia.plans.schema import ENTITY_KEY, INDEX, ORDINAL, ROW_KEY, Entity, PerEvent, PerPeriod, Table


def entity_key(name: str, index) -> Any:
    return F.concat(F.lit(f"{name}:"), index.cast("string"))


def population(spark, name: str, count: int, partitions: int | None = None) -> DataFrame:
    """Index and key of each entity; nothing is read or shuffled."""
    df = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return df.select(F.col("id").alias(INDEX), entity_key(name, F.col("id")).alias(ENTITY_KEY))


def covered(df: DataFrame, table: str, coverage: float, seed: int | str) -> DataFrame:
    """The entities that the table covers, each by a draw of its own."""
    return df if coverage >= 1.0 else df.filter(derive.unit(F.col(ENTITY_KEY), seed, f"coverage\0{table}") < coverage)


def expanded(df: DataFrame, table: str, grain: Any, seed: int | str) -> DataFrame:
    """The rows of the grain, with row key, ordinal and the grain's column; an entity's rows stay in its partition."""
    key = F.col(ENTITY_KEY)
    if isinstance(grain, PerPeriod):
        kind = period_type(grain.periods)
        value = (lambda p: str(p)) if kind.simpleString() == "string" else (lambda p: p)
        each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("o"), F.lit(str(p)).alias("k"), F.lit(value(p)).cast(kind).alias("p")) for i, p in enumerate(grain.periods)])
        rows = df.withColumn("_dv_p", F.explode(each))
        rows = rows.select(*df.columns, F.concat(key, F.lit("|"), F.col("_dv_p.k")).alias(ROW_KEY), F.col("_dv_p.o").alias(ORDINAL), F.col("_dv_p.p").alias(grain.period_column))
        presence = grain.presence.value
        return rows if presence >= 1.0 else rows.filter(derive.unit(F.col(ROW_KEY), seed, f"presence\0{table}") < presence)
    if isinstance(grain, PerEvent):
        n = derive.integers(key, seed, f"events\0{table}", grain.low, grain.high)
        counted = df.withColumn("_dv_n", n)
        counted = counted if grain.low > 0 else counted.filter("_dv_n > 0")
        rows = counted.withColumn(ORDINAL, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_dv_n") - 1)))
        return rows.select(*df.columns, F.concat(key, F.lit("|"), F.col(ORDINAL).cast("string")).alias(ROW_KEY), ORDINAL, F.col(ORDINAL).alias(grain.occurrence_column))
    return df.withColumn(ROW_KEY, key).withColumn(ORDINAL, F.lit(0).cast("bigint"))


def drawn(df: DataFrame, rules: Mapping[str, Rule], key: str, seed: int | str, salt: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Columns by their rules, with what they depend on; salt gets each column's name appended."""
    need: set[str] = set()
    stack = list(rules if wanted is None else wanted)
    while stack:
        name = stack.pop()
        if name in rules and name not in need:
            need.add(name)
            stack += rules[name].depends_on()
    for name in resolve_order(rules, df.columns):
        if name in need:
            df = rules[name].attach(df, name, key, seed, f"{salt}\0{name}")
    return df


def rows_per_entity(grain: Any) -> float:
    if isinstance(grain, PerPeriod):
        return max(1, int(len(grain.periods) * grain.presence.value))
    return max(1, (grain.low + grain.high) // 2) if isinstance(grain, PerEvent) else 1


@register("generator", "rules")
class RuleGenerator:
    """Expands a declared table from nothing but its rules."""

    def emit(self, table: Table, ctx: RunContext) -> DataFrame:
        entity: Entity = ctx.schema.entity(table.grain.entity)
        count = ctx.provenance.add(f"{entity.name}.count", entity.count)
        coverage = ctx.provenance.add(f"{table.name}.coverage", table.coverage)
        if isinstance(table.grain, PerPeriod):
            ctx.provenance.add(f"{table.name}.grain.presence", table.grain.presence)
        partitions = max(ctx.spark.sparkContext.defaultParallelism, -(-int(count * rows_per_entity(table.grain)) // ctx.partition_rows))
        entities = covered(population(ctx.spark, entity.name, count, min(partitions, count)), table.name, coverage, ctx.seed)
        rows = expanded(entities, table.name, table.grain, ctx.seed)
        own = [ENTITY_KEY, ROW_KEY, INDEX, ORDINAL, *([table.grain.column] if table.grain.column else [])]
        carried = drawn(rows, entity.attributes, ENTITY_KEY, ctx.seed, f"entity\0{entity.name}", table.carry)
        carried = carried.select(*own, *[F.col(f"`{c}`") for c in table.carry])
        out = drawn(carried, table.columns, ROW_KEY, ctx.seed, f"table\0{table.name}")
        out = out.select(*own, *[F.col(f"`{c}`") for c in [*table.carry, *table.columns]])
        ctx.report(table.name, "generate", entities_total=count, entities_covered=entities.count, rows=rows.count)
        return out
