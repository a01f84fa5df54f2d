"""Mixing sources to target weights, by hash-random order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm._common import WORD, checkpointed, word_count

#: Ranges of the random key in each source; each range is summed apart, so no source is ordered in one task.
RANGES = 1 << 16
#: Sources that one task puts in order.
IN_ORDER = 100_000


def in_order(rows: DataFrame, order: Sequence[Column], sums: dict[str, str], parts: int) -> DataFrame:
    """The rows with `place` (from 0) in an order, and for each result: column of `sums` the column's sum over the rows before.

    Rows are dealt to `parts` ranges of the order, each summed by itself, then the ranges' totals, one row each, are.
    """
    if parts > 1:
        rows = checkpointed(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    else:
        rows = rows.withColumn("__part", F.lit(0))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    columns = {"place": F.lit(1).cast("long"), **{k: F.col(c) for k, c in sums.items()}}
    before = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))
    out = rows.select("*", *[before(v, inside).alias(f"__in_{k}") for k, v in columns.items()])
    if parts == 1:
        return out.select(*[c for c in rows.columns if c != "__part"], *[F.col(f"__in_{k}").alias(k) for k in columns])
    totals = rows.groupBy("__part").agg(*[F.sum(v).alias(f"__all_{k}") for k, v in columns.items()])
    starts = totals.select("__part", *[before(F.col(f"__all_{k}"), across).alias(f"__start_{k}") for k in columns])
    out = out.join(starts, "__part")
    return out.select(*[c for c in rows.columns if c != "__part"], *[(F.col(f"__in_{k}") + F.col(f"__start_{k}")).alias(k) for k in columns])


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, most_in_order: int = IN_ORDER) -> DataFrame:
    """One row per source: source, source_size, target.

    The sources, by code point with null last, weigh `weights` in turn and share `share` of all sizes. A target stops
    at `most` times its source's size, and what is above goes to the others by weight: the fixed point is one water
    level w * level below the caps, found with prefix sums over the sources in the order of cap / weight.
    """
    parts = -(-max(sizes.count(), 1) // most_in_order)
    by_name = [F.col("source").asc_nulls_last()]
    weighed = in_order(sizes, by_name, {}, parts).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")).alias("w"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
    ).withColumn("by", F.col("cap") / F.col("w"))
    ranked = in_order(weighed, [F.col("by"), *by_name], {"caps_before": "cap", "w_before": "w"}, parts)
    total = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))  # one row
    level = (F.lit(float(share)) * F.col("all_size") - F.col("caps_before")) / (F.col("all_w") - F.col("w_before"))
    levelled = ranked.join(F.broadcast(total)).withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    final = levelled.agg(F.max(F.when(~F.col("capped"), F.col("level"))).alias("final"))  # one row
    return levelled.join(F.broadcast(final)).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def mix(
    docs: DataFrame, *, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, seed: int = 0, ranges: int = RANGES, most_in_order: int = IN_ORDER,
) -> DataFrame:
    """How much of each document the mix takes: the input's columns and size, source_size, target, taken.

    Each document gets the key md5(seed, id), a random order of its source that reruns repeat. The keys are cut into
    `ranges` ranges; the ranges' sums are added up first, then each range is ordered by itself, which gives prefix sums
    over a source without ordering it in one task. The source's budget is its target rounded; it takes every document
    as often as the budget holds the whole source, and once more in key order up to the rest, so the last one is cut
    to end on the budget exactly.

    A null size counts as 0, a null source is a source, repeated ids are told apart by size and else take the words of
    either. An empty table gives an empty one. Input columns that clash with the four results are replaced. Sources
    beyond `most_in_order` are put in order by ranges.
    """
    made = ["size", "source_size", "target", "taken"]
    rest = [c for c in docs.columns if c not in made]
    keyed = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")).select(
        *rest, F.col("__size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("__key"),
    )
    keyed = keyed.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int"))
    parts = checkpointed(keyed.groupBy(F.col(source_col).alias("source"), "__range").agg(F.sum("__size").alias("part")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, most, most_in_order)
    start = F.coalesce(F.sum("part").over(Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("__start", start).alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
    starts = starts.select(F.col("p.source").alias("__source"), F.col("__range").alias("__its"), "__start", "source_size", "target")
    inside = Window.partitionBy(source_col, "__range").orderBy("__key", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    out = out.join(starts, out[source_col].eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__its")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size")
    again = F.greatest(F.lit(0), F.least(F.col("__size"), left - F.col("__start") - F.col("__before")))
    return out.select(*rest, F.col("__size").alias("size"), "source_size", "target", (epochs * F.col("__size") + again).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last time cut after its share of words.

    Columns and types are those of the input; documents of which nothing is taken go, null and empty texts among them,
    and n_chars follows a cut text. Repeated rows are taken each by itself. An empty table gives an empty one.
    """
    taken = mix(docs, size=word_count(F.col("text")), **options)
    words, size = F.col("taken"), F.col("size")
    copies = F.ceil(words / size).cast("int")
    each = taken.filter(words > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), (words - (F.col("__copy") - 1) * size).cast("int")), "")
    text = F.when(F.col("__copy") * size <= words, F.col("text")).otherwise(cut)
    columns = [text.alias("text") if c == "text" else F.when(F.col("__copy") * size <= words, F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return each.select(*columns)
