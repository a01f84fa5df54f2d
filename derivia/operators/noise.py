"""Controlled corruption: missing values, typing errors, scan errors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.functions import derive
from derivia.plans.context import RunContext, once
from derivia.plans.provenance import as_tagged
from derivia.plans.registry import register
from derivia.plans.schema import ROW_KEY, Table

# Keys beside each key of a keyboard, and characters that scanners confuse.
NEIGHBOURS = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg", "g": "fh", "h": "gj", "i": "uo", "j": "hk", "k": "jl", "l": "k", "m": "n",
    "n": "bm", "o": "ip", "p": "o", "q": "wa", "r": "et", "s": "ad", "t": "ry", "u": "yi", "v": "cb", "w": "qe", "x": "zc", "y": "tu", "z": "x",
}
CONFUSED = {"0": "O", "O": "0", "1": "I", "I": "1", "l": "1", "5": "S", "S": "5", "8": "B", "B": "8", "2": "Z", "Z": "2", "6": "G", "G": "6"}


class NoiseOp:
    """Corrupts some rows of a column. rate: a probability, or a function of the row's columns (name to Column).

    Subclasses write `corrupt`, the corrupted value as a Column; `text` says whether the result is text.
    """

    text = True

    def __init__(self, rate: Any):
        self.rate = as_tagged(rate)
        value = self.rate.value
        if not callable(value) and not 0 <= value <= 1:
            raise ValueError(f"rate must be from 0 to 1, got {value!r}")

    @property
    def name(self) -> str:
        return type(self).__name__.lower()

    def corrupt(self, value: Column, key: Column, seed: int | str, salt: str) -> Column:
        raise NotImplementedError

    def probability(self, df: DataFrame, where: str = "") -> Column:
        """The rate as a Column; a function's is checked to be one of its row alone, and each value to be in [0, 1].

        `where` names the table and column in errors. A row's rate that is null, NaN or out of range fails the job.
        """
        if not callable(self.rate.value):
            return F.lit(float(self.rate.value))
        what = f"the rate function of {self.name}{' on ' + where if where else ''}"
        rate = self.rate.value({c: F.col(f"`{c}`") for c in df.columns if not c.startswith("_dv_")})
        if not isinstance(rate, Column):
            raise ValueError(f"{what} must return a Column, got {type(rate).__name__}")
        if not of_one_row(df, rate):
            raise ValueError(f"{what} must look at one row at a time, not at other rows")
        rate = rate.cast("double")
        fault = F.when(rate.isNull() | F.isnan(rate), "no number").when((rate < 0) | (rate > 1), "out of [0, 1]")
        message = F.concat(F.lit(f"{what} must give numbers from 0 to 1; here it is "), fault, F.lit(": "), F.coalesce(rate.cast("string"), F.lit("null")))
        return F.when(fault.isNotNull(), F.raise_error(message).cast("double")).otherwise(rate)


def of_one_row(df: DataFrame, value: Column) -> bool:
    """Whether a Column is a function of its row alone: selecting it puts one projection on the frame's plan, no more.

    An aggregate, window or generator makes an operator of its own there, whatever its columns are called.
    """
    plan = df.select(value.alias("_dv_value"))._jdf.queryExecution().analyzed()
    below = plan.children()
    return plan.nodeName() == "Project" and below.size() == 1 and below.head().equals(df._jdf.queryExecution().analyzed())


class Missing(NoiseOp):
    """Null instead of the value; the column keeps its type."""

    text = False

    def corrupt(self, value, key, seed, salt):
        return F.lit(None)


def _at(text: Column, place: Column) -> Column:
    """The character at a place from 1."""
    return F.substring(text, place, F.lit(1))


def slipped(text: Column, i: Column) -> Column:
    """Swap the character with its right neighbour, else its left one, if they differ; else double it. i counts from 1."""
    c, right, left = _at(text, i), _at(text, i + 1), F.when(i > 1, _at(text, i - 1)).otherwise("")
    return (
        F.when((right != "") & (right != c), F.overlay(text, F.concat(right, c), i, F.lit(2)))
        .when((left != "") & (left != c), F.overlay(text, F.concat(c, left), i - 1, F.lit(2)))
        .otherwise(F.overlay(text, F.concat(c, c), i, F.lit(1)))
    )


class Typo(NoiseOp):
    """One wrong key: a neighbour on the keyboard, in the same case; for other characters a slip. Null and '' stay."""

    def corrupt(self, value, key, seed, salt):
        text = value.cast("string")
        n = F.length(text)
        j = F.least(F.floor(derive.unit(key, seed, f"{salt}\0pos") * n), n - 1).cast("int")
        i = j + 1
        c = _at(text, i)
        options = F.element_at(F.create_map(*[F.lit(x) for pair in NEIGHBOURS.items() for x in pair]), F.lower(c))
        near = _at(options, j % F.length(options) + 1)
        near = F.when(c == F.lower(c), near).otherwise(F.upper(near))
        return F.when(n > 0, F.when(options.isNotNull(), F.overlay(text, near, i, F.lit(1))).otherwise(slipped(text, i))).otherwise(text)


class OCR(NoiseOp):
    """One character read as one that looks like it; texts without such a character, null and '' stay."""

    def corrupt(self, value, key, seed, salt):
        text = value.cast("string")
        n = F.length(text)
        places = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: _at(text, i).isin(*CONFUSED)))
        k = F.least(F.floor(derive.unit(key, seed, f"{salt}\0pos") * F.size(places)), F.size(places) - 1).cast("int")
        i = F.get(places, k)
        swap = F.element_at(F.create_map(*[F.lit(x) for pair in CONFUSED.items() for x in pair]), _at(text, i))
        return F.when(F.size(places) > 0, F.overlay(text, swap, i, F.lit(1))).otherwise(text)


def corrupted(df: DataFrame, column: str, op: NoiseOp, seed: int | str, salt: str, key: str = ROW_KEY, where: str = "") -> tuple[DataFrame, Column]:
    """The frame with one operation applied to a column, and the hit decision over the frame before."""
    value = F.col(f"`{column}`")
    hit = derive.unit(F.col(key), seed, salt) < op.probability(df, where or column)
    kind = "string" if op.text else df.schema[column].dataType
    return df.withColumn(column, F.when(hit, op.corrupt(value, F.col(key), seed, salt).cast(kind)).otherwise(value.cast(kind))), hit


@register("noiser", "noise")
class Noise:
    """Operations by table and column, applied in order. Typo and OCR make a column text; Missing keeps its type."""

    def __init__(self, ops: Mapping[str, Mapping[str, Sequence[NoiseOp]]]):
        self.ops = {t: {c: list(o) if isinstance(o, (list, tuple)) else [o] for c, o in columns.items()} for t, columns in ops.items()}

    def run(self, df: DataFrame, table: Table, ctx: RunContext) -> DataFrame:
        rates: dict[str, Callable[[], float]] = {}
        for column, ops in self.ops.get(table.name, {}).items():
            if column not in df.columns:
                raise KeyError(f"noise names column {column!r}, which table {table.name!r} lacks; it has {[c for c in df.columns if not c.startswith('_dv_')]}")
            for op in ops:
                ctx.provenance.add(f"{table.name}.noise.{column}.{op.name}.rate", op.rate)
                before = df
                df, hit = corrupted(df, column, op, ctx.seed, f"noise\0{table.name}\0{column}\0{op.name}", where=f"{table.name}.{column}")
                rates[f"{column}.{op.name}"] = once(lambda before=before, hit=hit: before.agg(F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))).first()[0])
        if rates:
            ctx.report(table.name, "noise", **rates)
        return df
