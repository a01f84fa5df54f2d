"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import checkpointed


#: Links, 16 bytes each, that one task joins up; more of them take rounds over all tasks.
ALONE = 200_000


def components(links: DataFrame, *, most_rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """One row per linked id: id, component (the smallest id it reaches), from links (a, b).

    Up to `alone` links are joined up by one task. Beyond, each round hangs every node's larger neighbours under its
    smallest one, then its smaller ones; no node's links are collected, only minima, which combine before the shuffle. The
    links of a round go to the checkpoint folder, and the rounds end when a round changes nothing. Direction, repeats and
    loops don't matter; without links the result is empty.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    if edges.count() <= alone:
        return edges.repartition(1).mapInArrow(_joined_up, "id long, component long")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(low).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every id of the links (u, v) with the smallest one it reaches."""
    parts = list(batches)
    u, v = (np.concatenate([b.column(c).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for c in ("u", "v"))
    up = dict(spanning(u, v))
    ids = np.unique(np.r_[u, v])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([up.get(i, i) for i in ids.tolist()], pa.int64())], ["id", "component"])


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links from each id to the smallest one it reaches over the given pairs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    return [(x, t) for x in list(up) if (t := top(x)) != x]
