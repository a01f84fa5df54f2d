"""Identifiers that join across tables without a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.functions import derive
from derivia.plans.context import RunContext
from derivia.plans.registry import register
from derivia.plans.schema import ENTITY_KEY, Table


@register("linker", "deterministic")
class DeterministicLinker:
    """Puts a table's identifiers first, each derived from the entity's key; without any the table passes through."""

    def run(self, df: DataFrame, table: Table, ctx: RunContext) -> DataFrame:
        if not table.identifiers:
            return df
        entity = ctx.schema.entity(table.grain.entity)
        ids = []
        for tag in table.identifiers:
            i = entity.identifier(tag)
            ids.append(derive.derive_id(F.col(ENTITY_KEY), ctx.seed, f"{entity.name}\0{i.tag}", prefix=i.prefix, digits=i.digits).alias(tag))
        ctx.report(table.name, "link", identifiers=list(table.identifiers))
        return df.select(*ids, *[F.col(f"`{c}`") for c in df.columns])
