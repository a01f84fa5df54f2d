"""Real and synthetic data compared: marginals, associations, verdicts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLDS = ("ks_pvalue", "category_share_delta", "association_delta")


def number(df: DataFrame, column: str) -> Column:
    """The column as a double; what is no number, NaN too, is null."""
    value = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    value = value.cast("int").cast("double") if isinstance(kind, T.BooleanType) else value.try_cast("double")
    return F.when(~F.isnan(value), value)


def share_delta(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row, delta: half the summed differences of the values' shares, nulls left out; null if a side has none."""
    side = lambda df, n: df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(F.count("*").alias(n))
    counts = side(a, "n").join(side(b, "m"), "v", "full")
    sums = counts.agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))
    shares = counts.join(F.broadcast(sums))  # one row
    return shares.agg((F.sum(F.abs(F.try_divide(F.coalesce("n", F.lit(0)), F.col("all_n")) - F.try_divide(F.coalesce("m", F.lit(0)), F.col("all_m")))) / 2).alias("delta"))


#: Ranges that a KS test's values are cut into, so that no task needs all of them in order.
KS_RANGES = 256


def _range_of(value: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted edges are at most the value, by a balanced tree of comparisons."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value < F.lit(edges[middle]), between(lo, middle)).otherwise(between(middle + 1, hi))

    return between(0, len(edges))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row, statistic, n, m: the largest difference of both distribution functions; null if a side is empty.

    Equal values are counted first. Their cumulative counts come from sums over ranges of the values, then from running
    sums within each range; the ranges hold about as many values each, whatever outliers there are, as their edges are
    approximate quantiles of the values that differ, which a job finds first.
    """
    one = a.select(number(a, column).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    both = one.union(b.select(number(b, column).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y"))).filter("v is not null")
    counts = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = counts.agg(F.percentile_approx("v", [k / KS_RANGES for k in range(1, KS_RANGES)], 4 * KS_RANGES)).first()[0]
    placed = counts.withColumn("r", _range_of(F.col("v"), sorted(set(found or []))))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("r").agg(F.sum("x").alias("rx"), F.sum("y").alias("ry"))
    total = Window.partitionBy()
    ranges = ranges.select("r", F.coalesce(F.sum("rx").over(before), F.lit(0)).alias("bx"), F.coalesce(F.sum("ry").over(before), F.lit(0)).alias("by"), F.sum("rx").over(total).alias("n"), F.sum("ry").over(total).alias("m"))
    run = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = placed.join(F.broadcast(ranges), "r").select(F.try_divide(F.col("bx") + F.sum("x").over(run), F.col("n")).alias("f"), F.try_divide(F.col("by") + F.sum("y").over(run), F.col("m")).alias("g"), "n", "m")
    return cum.agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("statistic"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_pvalue(statistic: float, n: int, m: int) -> float:
    """The two-sided p-value: by counting lattice paths up to 10,000 values a side, beyond by Kolmogorov's limit."""
    if max(n, m) <= 10_000:
        g = math.gcd(n, m)
        h = round(statistic * (n // g) * m)
        if h == 0:
            return 1.0
        # Paths from (0, 0) to (n, m) that stay within |i/n - j/m| < statistic, row by row, scaled as they grow.
        scale, a, b = n // g * m, n // g, m // g
        j = np.arange(m + 1)
        row, log = np.zeros(m + 1), 0.0
        for i in range(n + 1):
            inside = np.abs(i * b - j * a) < h
            if i == 0:
                row = (np.cumsum(~inside) == 0).astype(float)
            else:
                row = np.where(inside, row, 0.0)
                at = np.flatnonzero(inside)
                if not len(at):
                    return 1.0
                row[at] = np.cumsum(row[at])
                top = row.max()
                if top > 1e200:
                    row /= top
                    log += math.log(top)
        del scale
        if row[m] <= 0:
            return 1.0
        inside_log = math.log(row[m]) + log - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
        return min(1.0, max(0.0, -math.expm1(inside_log)))
    lam = math.sqrt(n * m / (n + m)) * statistic
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, value: correlation over rows with both numbers; null with fewer than two, or without spread."""
    pair = df.select(number(df, a).alias("x"), number(df, b).alias("y")).filter("x is not null and y is not null")
    spread = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return pair.agg(F.when(spread, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("value"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, value: Cramer's V without corrections; null with fewer than two values of either.

    Chi-squared is n (sum of o^2 / (row total * column total) - 1), so empty cells need not be listed.
    """
    pair = df.select(F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")).filter("x is not null and y is not null")
    cells = pair.groupBy("x", "y").agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("rx")), cells.groupBy("y").agg(F.sum("o").alias("cy"))
    sums = cells.join(rows, "x").join(cols, "y").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("rx").cast("double") * F.col("cy"))).alias("s"), F.sum("o").alias("n"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c")
    )
    return sums.select(F.when((F.col("r") > 1) & (F.col("c") > 1), F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (F.least("r", "c") - 1))).alias("value"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row, value: eta, the root of the variation between categories over all; null where it isn't defined."""
    pair = df.select(F.col(f"`{category}`").cast("string").alias("c"), number(df, value).alias("x")).filter("c is not null and x is not null")
    groups = pair.groupBy("c").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("within"))
    all_ = groups.agg(F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("n").alias("total"))
    joined = groups.join(F.broadcast(all_))  # one row
    sums = joined.agg(F.sum(F.col("n") * (F.col("mean") - F.col("s") / F.col("total")) ** 2).alias("between"), F.sum("within").alias("within"), F.count("*").alias("k"), F.sum("n").alias("size"))
    total = F.col("between") + F.col("within")
    return sums.select(F.when((F.col("k") > 1) & (F.col("size") > 1) & (total > 0), F.sqrt(F.col("between") / total)).alias("value"))


def association(df: DataFrame, a: str, b: str, numeric: set[str]) -> tuple[str, DataFrame]:
    if a in numeric and b in numeric:
        return "pearson", pearson(df, a, b)
    if a not in numeric and b not in numeric:
        return "cramers_v", cramers_v(df, a, b)
    return "correlation_ratio", correlation_ratio(df, *((b, a) if a in numeric else (a, b)))


@dataclass
class FidelityReport:
    columns: list[str]
    column_stats: DataFrame
    associations: DataFrame
    empty_donor_leaves: dict[str, dict[str, int]]
    thresholds: dict[str, float] | None = None

    def to_frame(self) -> DataFrame:
        return self.column_stats


def fidelity_report(synth: DataFrame, real: DataFrame, columns: Sequence[str], *, thresholds: Mapping[str, float] | None = None, synthesizer: Any = None) -> FidelityReport:
    """Compare a synthesized table with the real one: each column, and each pair of columns.

    The real frame says which columns are numbers (truth values count as such). thresholds turn verdicts on: ks_pvalue
    at least, category_share_delta and association_delta at most; a check without threshold, or that has no value, has
    none. synthesizer: fills empty_donor_leaves.
    """
    columns = list(columns)
    if not columns:
        raise ValueError("fidelity_report needs a column")
    missing = {side: [c for c in columns if c not in df.columns] for side, df in (("real", real), ("synth", synth))}
    if any(missing.values()):
        raise KeyError(f"columns that a frame lacks: {missing}")
    if synthesizer is not None and not (hasattr(synthesizer, "donor_diagnostics") and hasattr(synthesizer, "columns")):
        raise TypeError(f"{type(synthesizer).__name__} has no donor diagnostics")
    limits = dict(thresholds or {})
    numeric = {c for c in columns if isinstance(real.schema[c].dataType, (T.NumericType, T.BooleanType))}
    spark, stats, pairs = real.sparkSession, [], []
    for c in columns:
        if c in numeric:
            s, n, m = ks(real, synth, c).first()
            p = None if s is None or not n or not m else ks_pvalue(s, n, m)
            stats.append((c, "numeric", "ks", s if p is not None else None, p, None if p is None or "ks_pvalue" not in limits else p >= limits["ks_pvalue"]))
        else:
            d = share_delta(real, synth, c).first()[0]
            d = 1.0 if d is None and (real.filter(F.col(f"`{c}`").isNotNull()).isEmpty() != synth.filter(F.col(f"`{c}`").isNotNull()).isEmpty()) else d or 0.0
            stats.append((c, "categorical", "category_share_delta", d, None, None if "category_share_delta" not in limits else d <= limits["category_share_delta"]))
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            metric, x = association(real, a, b, numeric)
            x, y = x.first()[0], association(synth, a, b, numeric)[1].first()[0]
            delta = None if x is None or y is None else abs(x - y)
            pairs.append((a, b, metric, x, y, delta, None if delta is None or "association_delta" not in limits else delta <= limits["association_delta"]))
    return FidelityReport(
        columns,
        spark.createDataFrame(stats, "column string, kind string, metric string, value double, pvalue double, passed boolean"),
        spark.createDataFrame(pairs, "column_a string, column_b string, metric string, real double, synth double, delta double, passed boolean"),
        {t: {c: n for c, n in v.items() if c in columns} for t, v in synthesizer.donor_diagnostics().items()} if synthesizer is not None else {},
        limits or None,
    )
