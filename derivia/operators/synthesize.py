"""Synthesis column by column: a tree finds a row's leaf, and the value is drawn from the leaf's donors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from derivia.functions import derive
from derivia.operators import cart
from derivia.operators.structure import coerce_structure
from derivia.plans.context import RunContext
from derivia.plans.provenance import as_tagged, modeled
from derivia.plans.registry import register
from derivia.plans.schema import INDEX, ORDINAL, ROW_KEY, Table
from derivia.plans.shipping import ship

#: Rows that a fit holds at most; also the bound of what the driver holds and of the donors that are broadcast.
FIT_CAP = 200_000
#: Codes of so many categories or fewer become a map in the expression, more of them a broadcast join.
MAP_CATEGORIES = 256


def _sized(table: DataFrame, rows: int) -> DataFrame:
    """A table to join, broadcast only if it has no more rows than the default cap; a larger one is for the engine to judge."""
    return F.broadcast(table) if rows <= FIT_CAP else table


#: Copies of a row that are told apart by one row of a generator.
COPIES = 10_000


def _told_apart(frame: DataFrame, text: Column) -> DataFrame:
    """The rows with `_dv_text` and `_dv_nth`, their number among equal ones. Equal rows are counted, never gathered."""
    counted = frame.groupBy(*[F.col(f"`{c}`") for c in frame.columns]).agg(F.count("*").alias("_dv_n")).withColumn("_dv_text", text)
    runs = counted.withColumn("_dv_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_dv_n") - 1) / COPIES))))
    last = F.least(F.col("_dv_n"), (F.col("_dv_run") + 1) * COPIES)
    dealt = runs.repartition("_dv_text", "_dv_run")
    return dealt.withColumn("_dv_nth", F.explode(F.sequence(F.col("_dv_run") * COPIES + 1, last))).drop("_dv_n", "_dv_run")


def training_sample(frame: DataFrame, cap: int, seed: int | str, table: str, order_by: Sequence[str] = ()) -> tuple[pd.DataFrame, bool]:
    """At most cap rows in a fixed order, and whether that is a sample.

    Above cap each row stays by a draw on its identity: its order key, or its content and number among equal rows, so
    no row is numbered across the whole frame. The rest in order are cut to cap, a bounded top-k.
    """
    columns = [c for c in frame.columns if c not in order_by or not c.startswith("_dv_")]
    order = [F.col(f"`{c}`") for c in order_by] or [F.col(f"`{c}`").asc_nulls_first() for c in sorted(frame.columns)]
    n = frame.count()
    if n > cap:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in (list(order_by) or sorted(frame.columns))]))
        keyed = frame.withColumn("_dv_text", text).withColumn("_dv_nth", F.lit(1)) if order_by else _told_apart(frame, text)
        frame = keyed.filter(derive.unit(F.concat_ws("|", "_dv_text", "_dv_nth"), seed, f"fitsample\0{table}") < cap / n)
    return frame.orderBy(*order).limit(cap).select(*[F.col(f"`{c}`") for c in columns]).toPandas(), n > cap


#: Different donors that are numbered in one task, about, and the ranges of their order at most.
RANGE_ROWS, RANGES = 50_000, 1024


def _ranged(rows: DataFrame, order: Sequence[str], n: int) -> Column:
    """The range of a row's place in the order, some RANGE_ROWS of n rows each; equal rows share one.

    The edges come from a sample; which ones they are changes how the work is dealt, not the order.
    """
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return F.lit(0)
    types = [rows.schema[c].dataType for c in order]
    drawn = rows.sample(min(1.0, 32 * ranges / n), 1).select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)]).distinct()
    picked = drawn.orderBy(*drawn.columns).collect()
    edges = picked[:: -(-len(picked) // ranges) or 1][1:]
    key = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)])

    def found(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        edge = F.struct(*[F.lit(v).cast(t).alias(f"_{i}") for i, (v, t) in enumerate(zip(edges[middle], types, strict=True))])
        return F.when(key < edge, found(low, middle)).otherwise(found(middle + 1, high))

    return found(0, len(edges))


@dataclass
class Pool:
    """Donors as intervals of slots, `from` up to, not including, `to`: a row for each cell of `width` slots that one touches."""

    frame: DataFrame
    rows: int
    width: int
    places: dict[int, tuple[int, int]]

    def drawn(self, df: DataFrame, slot: Column) -> DataFrame:
        """The rows with `_dv_donor`, what the donor in their slot holds."""
        at = df.withColumn("_dv_slot", slot.cast("long")).withColumn("_dv_cell", F.expr(f"_dv_slot div {self.width}"))
        inside = (F.col("_dv_slot") >= F.col("_dv_from")) & (F.col("_dv_slot") < F.col("_dv_to"))
        pool = _sized(self.frame, self.rows).withColumnRenamed("_dv_cell", "_dv_of")
        return at.join(pool, (F.col("_dv_cell") == F.col("_dv_of")) & inside, "left")


def pooled(rows: DataFrame, leaf: Column, target: str, order_by: Sequence[str] = ()) -> Pool:
    """Every row a donor of its leaf, numbered from the leaf's start in the rows' order, or that of their content.

    Equal rows are counted, not numbered one by one, and the others are numbered range by range of their order, so
    neither many copies nor one large leaf come to a single task, and the driver holds no more than the leaves.
    """
    own = [c for c in rows.columns if not c.startswith("_dv_code_")]
    order = [*order_by, *sorted(c for c in own if c not in order_by)]
    keys = [F.col(f"`{c}`") for c in order]
    counted = rows.withColumn("_dv_leaf", leaf).groupBy("_dv_leaf", *keys).agg(F.count("*").alias("_dv_n"))
    sizes = sorted(counted.groupBy("_dv_leaf").agg(F.sum("_dv_n"), F.count("*")).collect())
    n, different = sum(r[1] for r in sizes), sum(r[2] for r in sizes)
    starts = np.concatenate(([0], np.cumsum([r[1] for r in sizes])[:-1])).tolist()
    ranged = counted.withColumn("_dv_range", _ranged(rows, order, n))
    before = Window.partitionBy("_dv_leaf").orderBy("_dv_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_dv_leaf", "_dv_range").agg(F.sum("_dv_n").alias("_dv_sum")).withColumn("_dv_before", F.coalesce(F.sum("_dv_sum").over(before), F.lit(0)))
    first = rows.sparkSession.createDataFrame([(r[0], int(s)) for r, s in zip(sizes, starts, strict=True)], T.StructType([T.StructField("_dv_leaf", T.IntegerType()), T.StructField("_dv_start", T.LongType())]))
    offsets = sums.join(_sized(first, len(sizes)), "_dv_leaf").select("_dv_leaf", "_dv_range", (F.col("_dv_start") + F.col("_dv_before")).alias("_dv_offset"))
    upto = F.sum("_dv_n").over(Window.partitionBy("_dv_leaf", "_dv_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_dv_upto", upto).join(offsets, ["_dv_leaf", "_dv_range"])
    width = max(1, n // different)
    to = F.col("_dv_offset") + F.col("_dv_upto")
    intervals = placed.select(F.col(f"`{target}`").alias("_dv_donor"), (to - F.col("_dv_n")).alias("_dv_from"), to.alias("_dv_to"))
    # Two steps, so that no array holds all the cells of a donor with very many copies.
    runs = intervals.withColumn("_dv_run", F.explode(F.expr(f"sequence(_dv_from div {width} div {COPIES}, (_dv_to - 1) div {width} div {COPIES})")))
    cells = F.expr(f"sequence(greatest(_dv_from div {width}, _dv_run * {COPIES}), least((_dv_to - 1) div {width}, _dv_run * {COPIES} + {COPIES - 1}))")
    return Pool(runs.withColumn("_dv_cell", F.explode(cells)).drop("_dv_run"), different + -(-n // width), width, {r[0]: (s, r[1]) for r, s in zip(sizes, starts, strict=True)})


def counted_rows(frame: DataFrame, cap: int, wanted: Sequence[str], order_by: Sequence[str] = ()) -> tuple[pd.DataFrame, np.ndarray] | None:
    """All rows as their different ones, in the order of the first of each, and how many there are of each; None above cap."""
    keys = [F.col(f"`{c}`") for c in wanted]
    first = F.min(F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order_by)])) if order_by else F.lit(0)
    counted = frame.groupBy(*keys).agg(F.count("*").alias("_dv_weight"), first.alias("_dv_first"))
    found = counted.orderBy("_dv_first", *[F.col(f"`{c}`") for c in sorted(wanted)]).drop("_dv_first").limit(cap + 1).toPandas()
    return None if len(found) > cap else (found, found.pop("_dv_weight").to_numpy(float))


class FittedCART:
    """Trees and donors, one of each for a synthesized column. The donors are the training rows, or those of a frame in its order."""

    def __init__(self, columns: Sequence[str], predictors: Sequence[str], numeric: Sequence[str], types: Mapping[str, T.DataType], train: pd.DataFrame, *, max_depth: int | None, min_leaf: int, seed: int | str, donors: DataFrame | None = None, order_by: Sequence[str] = (), weights: np.ndarray | None = None):
        self.donors, self.order_by = donors, list(order_by)
        self.columns, self.predictors, self.types = list(columns), list(predictors), dict(types)
        self.train, self.seed = train, seed
        self.is_number = {c: c in numeric or isinstance(types[c], (T.NumericType, T.BooleanType)) for c in [*columns, *predictors]}
        self.codes: dict[str, dict[Any, int]] = {c: {v: i for i, v in enumerate(pd.unique(train[c].dropna()))} for c, number in self.is_number.items() if not number}
        self.trees: dict[str, tuple[cart.Tree, list[str]]] = {}
        self.leaf_rows: dict[str, dict[int, np.ndarray]] = {}
        for i, target in enumerate(self.columns):
            features = self.predictors + self.columns[:i]
            if not features:
                continue
            x = np.column_stack([self._encoded(f) for f in features])
            y = self._encoded(target) if self.is_number[target] else self._encoded(target).astype(np.int64)
            tree = cart.fit(x, y, None if self.is_number[target] else len(self.codes[target]) + 1, features, max_depth=max_depth, min_leaf=min_leaf, seed=seed, target=target, weights=weights)
            leaf = tree.apply(x)
            order = np.argsort(leaf, kind="stable")
            found, at = np.unique(leaf[order], return_index=True)
            self.trees[target] = tree, features
            self.leaf_rows[target] = dict(zip(found.tolist(), np.split(order, at[1:]), strict=True))

    def _encoded(self, column: str) -> np.ndarray:
        """Numbers as they are, null as 0; categories as codes in order of appearance, null as -1."""
        values = self.train[column]
        if not self.is_number[column]:
            return values.map(self.codes[column]).fillna(-1).to_numpy(float)
        numbers = pd.to_numeric(values, errors="coerce")
        bad = values[numbers.isna() & values.notna()]
        if len(bad):
            raise ValueError(f"column {column!r} is to be numeric, but {len(bad)} values are no numbers, e.g. {sorted(set(map(str, bad)))[:3]}")
        return numbers.fillna(0.0).to_numpy(float)

    def _feature(self, df: DataFrame, column: str) -> tuple[DataFrame, Column]:
        value = F.col(f"`{column}`")
        if self.is_number[column]:
            number = value.try_cast("double") if isinstance(self.types[column], T.StringType) else value.cast("double")
            return df, F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))
        codes = self.codes[column]
        if len(codes) <= MAP_CATEGORIES:
            if not codes:
                return df, F.lit(-1.0)
            table = F.create_map(*[F.lit(x) for v, i in codes.items() for x in (v, float(i))])
            return df, F.coalesce(F.try_element_at(table, value.cast("string") if isinstance(self.types[column], T.StringType) else value), F.lit(-1.0))
        name = f"_dv_code_{column}"
        known = df.sparkSession.createDataFrame(list(codes.items()), T.StructType([T.StructField("_dv_v", self.types[column]), T.StructField(name, T.LongType())]))
        joined = df.join(_sized(known, len(codes)), value == F.col("_dv_v"), "left").drop("_dv_v")
        return joined, F.coalesce(F.col(name).cast("double"), F.lit(-1.0))

    def _donated(self, df: DataFrame, target: str, slot: Column, donors: np.ndarray) -> DataFrame:
        """The value of the donor in each row's slot, in place of the target column."""
        names, kind = df.columns, self.types[target]
        values = pa.array(self.train[target].iloc[donors], from_pandas=True).cast(to_arrow_type(kind))
        pool = df.sparkSession.createDataFrame(pa.table({"_dv_slot": pa.array(np.arange(len(donors))), "_dv_donor": values}))
        joined = df.withColumn("_dv_slot", slot.cast("long")).join(_sized(pool, len(donors)), "_dv_slot", "left")
        return joined.select(*[F.col("_dv_donor").cast(kind).alias(c) if c == target else F.col(f"`{c}`") for c in names])

    def apply(self, df: DataFrame, seed: int | str, table: str) -> DataFrame:
        names = df.columns
        for target in self.columns:
            salt = f"synth\0{table}\0{target}"
            if target not in self.trees:
                if self.donors is not None:
                    pool = pooled(self.donors, F.lit(0), target, self.order_by)
                    df = self._put(pool.drawn(df, derive.integers(F.col(ROW_KEY), seed, salt, 0, pool.places[0][1])), target, names)
                    continue
                slot = derive.integers(F.col(ROW_KEY), seed, salt, 0, len(self.train))
                df = self._donated(df, target, slot, np.arange(len(self.train)))
                continue
            tree, features = self.trees[target]
            df, columns = self._features(df, features)
            u = derive.unit(F.col(ROW_KEY), seed, salt)
            rows, pool = self.leaf_rows[target], None
            leaves = list(rows)
            if self.donors is None:
                sizes = [len(rows[k]) for k in leaves]
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
            else:
                pool = self._pool(target)
                if lost := set(leaves) - set(pool.places):
                    raise ValueError(f"{len(lost)} leaves of {target!r} have no donors")
                starts, sizes = zip(*(pool.places[k] for k in leaves), strict=True)
            if len(leaves) <= cart.CASE_LEAVES:
                place = tree.column(columns, {k: F.struct(F.lit(int(s)).cast("long").alias("s"), F.lit(int(n)).cast("long").alias("n")) for k, s, n in zip(leaves, starts, sizes, strict=True)})
                df = df.withColumn("_dv_place", place)
                slot = F.col("_dv_place.s") + F.least(F.floor(u * F.col("_dv_place.n")), F.col("_dv_place.n") - 1)
            else:
                slot = _looked_up(df.sparkSession, tree, dict(zip(leaves, zip(starts, sizes, strict=True), strict=True)))(u, *columns)
            if pool is not None:
                df = self._put(pool.drawn(df, slot), target, names)
                continue
            df = self._donated(df, target, slot, np.concatenate([rows[k] for k in leaves])).select(*[F.col(f"`{c}`") for c in names])
        return df

    def _features(self, df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[Column]]:
        columns = []
        for f in features:
            df, column = self._feature(df, f)
            columns.append(column)
        return df, columns

    def _pool(self, target: str) -> Pool:
        """The frame's donors by the leaf that each falls into."""
        tree, features = self.trees[target]
        rows, columns = self._features(self.donors, features)
        if len(tree.leaves) <= cart.CASE_LEAVES:
            leaf = tree.column(columns, {int(k): F.lit(int(k)) for k in tree.leaves})
        else:
            leaf = _looked_up(rows.sparkSession, tree, {int(k): (int(k), 1) for k in tree.leaves})(F.lit(0.0), *columns)
        return pooled(rows, leaf.cast("int"), target, self.order_by)

    def _put(self, drawn: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
        kind = self.types[target]
        return drawn.select(*[F.col("_dv_donor").cast(kind).alias(c) if c == target else F.col(f"`{c}`") for c in names])


def _looked_up(spark, tree: cart.Tree, places: Mapping[int, tuple[int, int]]):
    """A vectorised function of the draw and the features that gives the donor's slot; for trees too large for an expression."""
    ship(spark)
    start, size = np.zeros(len(tree.feature), np.int64), np.ones(len(tree.feature), np.int64)
    for leaf, (s, n) in places.items():
        start[leaf], size[leaf] = s, n
    shared = spark.sparkContext.broadcast((tree, start, size))

    @F.pandas_udf("long")
    def slot(u: pd.Series, *features: pd.Series) -> pd.Series:
        tree, start, size = shared.value
        leaf = tree.apply(np.column_stack([f.to_numpy(float) for f in features]))
        return pd.Series(start[leaf] + np.minimum((u.to_numpy() * size[leaf]).astype(np.int64), size[leaf] - 1))

    return slot


@register("synthesizer", "cart")
class CARTSynthesizer:
    """Sequential synthesis by trees, fitted once for a table and applied to every row.

    columns: to synthesize, each conditioned on those before it. predictors: to condition on only. tables: the tables
    to apply it to, all if unset. numeric: text columns that hold numbers. structure: what to learn from. fit_cap,
    max_depth, min_samples_leaf: how closely to fit. label: tells several synthesizers of one table apart in reports.
    A fit_cap bounds the rows of a structure source that are learned from and drawn. Unset, every row is drawn from,
    and trees are fitted on all rows if no more than the default cap differ, else on a sample of so many.
    """

    def __init__(self, columns: Sequence[str], *, tables: Sequence[str] | None = None, predictors: Sequence[str] = (), numeric: Sequence[str] = (), structure: Any = None, fit_cap: Any = None, max_depth: int | None = None, min_samples_leaf: Any = 5, label: str | None = None):
        if not columns:
            raise ValueError("CARTSynthesizer needs a column to synthesize")
        self.columns, self.predictors, self.numeric = list(columns), list(predictors), set(numeric)
        self.tables = None if tables is None else set(tables)
        self.structure = coerce_structure(structure)
        self.draws_all = fit_cap is None
        self.fit_cap = modeled(FIT_CAP, "default cap of rows to fit on") if fit_cap is None else as_tagged(fit_cap)
        self.max_depth, self.label = max_depth, label
        self.min_samples_leaf = modeled(min_samples_leaf, "leaf size") if isinstance(min_samples_leaf, int) else as_tagged(min_samples_leaf)
        self._diagnostics: dict[str, dict[str, int]] = {}

    def donor_diagnostics(self, table: str | None = None) -> dict[str, dict[str, int]]:
        """Rows by table and column that met a leaf without donors. Every leaf is made of its donors, so there are none."""
        return {k: dict(v) for k, v in self._diagnostics.items() if table in (None, k)}

    def run(self, df: DataFrame, table: Table, ctx: RunContext) -> DataFrame:
        if self.tables is not None and table.name not in self.tables:
            return df
        suffix = f".{self.label}" if self.label else ""
        cap = ctx.provenance.add(f"{table.name}.synth{suffix}.fit_cap", self.fit_cap)
        leaf = ctx.provenance.add(f"{table.name}.synth{suffix}.min_samples_leaf", self.min_samples_leaf)
        if self.numeric:
            ctx.provenance.add(f"{table.name}.synth{suffix}.numeric", modeled(sorted(self.numeric), "columns declared numeric"))
        frame = self.structure.training_frame(table, ctx)
        wanted = list(dict.fromkeys([*self.columns, *self.predictors]))
        source = df if frame is None else frame
        missing = [c for c in wanted if c not in source.columns]
        if missing:
            raise KeyError(f"table {table.name!r}: the structure source has no {missing}; it has {sorted(c for c in source.columns if not c.startswith('_dv_'))}")
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise KeyError(f"table {table.name!r} has no {missing} to synthesize")
        quoted = [F.col(f"`{c}`") for c in wanted]
        donors, order, weights, fit_rows = None, [], None, None
        if frame is None:
            train, sampled = df.orderBy(INDEX, ORDINAL).limit(cap).select(*quoted).toPandas(), False
            if train.empty:
                return df
        else:
            order = list(getattr(self.structure, "order_by", ()))
            kept = [*quoted, *[F.col(f"`{c}`") for c in order if c not in wanted]]
            rows = frame.select(*kept)
            if self.draws_all and (n := rows.count()) > cap:
                donors = rows
            if donors is not None and len(wanted) == 1:
                train, sampled, fit_rows = rows.limit(0).toPandas(), False, n  # no tree, only draws
            elif donors is not None and (whole := counted_rows(rows, cap, wanted, order)):
                (train, weights), sampled, fit_rows = whole, False, n
            else:
                train, sampled = training_sample(rows, cap, ctx.seed, table.name, order)
        model = FittedCART(self.columns, self.predictors, self.numeric, {c: source.schema[c].dataType for c in wanted}, train, max_depth=self.max_depth, min_leaf=leaf, seed=ctx.seed, donors=donors, order_by=order, weights=weights)
        self._diagnostics[table.name] = {}
        ctx.report(table.name, f"synthesize{suffix}", fit_rows=len(train) if fit_rows is None else fit_rows, fit_cap=cap, sampled=sampled, columns=list(self.columns), numeric=sorted(self.numeric), source=type(self.structure).__name__)
        return model.apply(df, ctx.seed, table.name)


class ChainedSynthesizer:
    """Several synthesizers in a row."""

    def __init__(self, synthesizers: Sequence[CARTSynthesizer]):
        self.synthesizers = list(synthesizers)

    @property
    def columns(self) -> list[str]:
        return [c for s in self.synthesizers for c in s.columns]

    def donor_diagnostics(self, table: str | None = None) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for s in self.synthesizers:
            for k, v in s.donor_diagnostics(table).items():
                out.setdefault(k, {}).update(v)
        return out

    def run(self, df: DataFrame, table: Table, ctx: RunContext) -> DataFrame:
        for s in self.synthesizers:
            df = s.run(df, table, ctx)
        return df
