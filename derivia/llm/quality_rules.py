"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import WORD

#: Labelled rows that a list is learned from at most, in the order of md5(seed, id).
SAMPLE_ROWS = 20_000

#: What the conditions look at: shares, so that long and short texts compare.
RATIOS = {
    "symbols_per_word": lambda c: c["n_symbols"] / F.greatest(c["n_words"], F.lit(1)),
    "chars_per_word": lambda c: c["word_chars"] / F.greatest(c["n_words"], F.lit(1)),
    "repeat_share": lambda c: c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1)),
    "dup_lines_per_100_words": lambda c: 100 * c["n_dup_lines"] / F.greatest(c["n_words"], F.lit(1)),
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    A null text has no words. A text's three-word windows are sorted beside their places, so equal ones are neighbours: a
    text of n words costs n log n, in memory of a few times its size, and needs no shuffle. Input columns of these names
    are replaced.
    """
    kept = [c for c in docs.columns if c not in STATISTICS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(*kept, _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__words"))
    w, n = F.col("__words"), F.size("__words")
    windows = F.when(n < 3, F.array().cast("array<struct<h:string,i:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("int").alias("i"))))
    )
    hashed = words.select(*kept, n.cast("long").alias("n_words"), _once(windows, "__windows"))
    v = F.col("__windows")
    same = lambda x, k: F.coalesce(F.get(v, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(v, lambda x, k: same(x, k - 1) | same(x, k + 1))
    found = hashed.select(*kept, "n_words", _once(F.sort_array(F.transform(twice, lambda x: x["i"])), "__at"))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    stats = F.struct(
        "n_words",
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return found.select(*kept, _once(stats, "__stats")).select(*kept, "__stats.*")


def _once(value: Column, name: str) -> Column:
    """A column behind a one-row generator.

    The optimizer inlines a projected column into filters above it and then into lambdas, where it would be evaluated
    for each element; it doesn't move expressions through a generator.
    """
    return F.explode(F.array(value)).alias(name)


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.threshold if self.above else features[self.feature] <= self.threshold

    def holds(self, rows: np.ndarray, names: Sequence[str]) -> np.ndarray:
        x = rows[:, list(names).index(self.feature)]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; a row that meets one is rejected, the rest are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self, features: dict[str, Column]) -> Column:
        if not self.rules:
            return F.lit(True)
        out = None
        for rule in self.rules:
            met = rule[0].column(features)
            for c in rule[1:]:
                met = met & c.column(features)
            out = F.when(met, False) if out is None else out.when(met, False)
        return out.otherwise(True)

    def rejects(self, rows: np.ndarray, names: Sequence[str]) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(rows, names) for c in rule])
        return out


def _best_condition(rows: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[float, Condition] | None:
    """The condition of most information gain for the bad rows, over all midpoints of all features; ties: the first."""
    p0, n0 = bad.sum(), (~bad).sum()
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), None
    for k, name in enumerate(names):
        order = np.argsort(rows[:, k], kind="stable")
        x, y = rows[order, k], bad[order]
        cuts = np.flatnonzero(x[1:] > x[:-1])
        if not len(cuts):
            continue
        p_low, n_low = np.cumsum(y)[cuts], np.cumsum(~y)[cuts]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-9):
                best = float(gain[i]), Condition(name, above, float((x[cuts[i]] + x[cuts[i] + 1]) / 2))
    return best


def sequential_covering(
    rows: np.ndarray, bad: np.ndarray, prune_set: np.ndarray, names: Sequence[str], *, precision: float = 0.9, least: int = 3, most_conditions: int = 4, most_rules: int = 16,
) -> DecisionList:
    """Grow a conjunction on two thirds of the rows, prune it on the others, take it if it is precise there, and cover on.

    Growing adds the condition of most gain until no good row is met. Pruning drops last conditions while
    (p - n) / (p + n) on the prune set doesn't fall. The list ends with the first rule under `precision` or `least`
    rejected rows, at `most_rules`, or when no bad row is left. Without bad rows, or without good ones to tell them
    from, the list is empty and keeps everything.
    """
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules and bad[left & ~prune_set].any():
        rule: list[Condition] = []
        met = left & ~prune_set
        while len(rule) < most_conditions and (best := _best_condition(rows[met], bad[met], names)):
            rule.append(best[1])
            met &= rule[-1].holds(rows, names)
        if not rule:
            break

        def tally(part: Sequence[Condition], where: np.ndarray) -> tuple[int, int]:
            hit = where & np.logical_and.reduce([c.holds(rows, names) for c in part])
            return int(bad[hit].sum()), int((~bad[hit]).sum())

        worth = lambda part: (lambda p, n: (p - n) / max(p + n, 1))(*tally(part, left & prune_set))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        (p, n), (gp, gn) = tally(rule, left & prune_set), tally(rule, left)
        if p < least or p < precision * (p + n) or gp < precision * (gp + gn):
            break
        rules.append(tuple(rule))
        left &= ~np.logical_and.reduce([c.holds(rows, names) for c in rule])
    return DecisionList(tuple(rules))


def features_of(names: Sequence[str] = tuple(RATIOS)) -> dict[str, Column]:
    stats = {c: F.col(c) for c in STATISTICS}
    return {k: RATIOS[k](stats) for k in names}


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE_ROWS, seed: int = 0, **options) -> DecisionList:
    """A list that rejects what is like the rows labelled 0.

    It is learned from at most `sample` labelled ids, the first in the order of md5(seed, id); an id with several
    labels has their lowest, null ids and labels are left out, and rows that fail the base rule teach nothing. Only
    these ids, a bounded set, are broadcast; the statistics come from the same expressions that score the corpus.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    picked = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__label"))
        .withColumn("__order", order).orderBy("__order", id_col).limit(sample)
    )
    labelled = docs.join(F.broadcast(picked), id_col).select(id_col, "text", "__label", "__order")
    stats = with_statistics(labelled).filter(~base_failed())
    names = tuple(RATIOS)
    # An id may have any number of rows; its least statistics teach for all of them.
    each = stats.select(F.col(id_col).alias("__id"), "__order", "__label", F.struct(*[c.alias(k) for k, c in features_of(names).items()]).alias("__x"))
    rows = each.groupBy("__id").agg(F.first("__order").alias("order"), F.first("__label").alias("label"), F.min("__x").alias("x")).collect()  # at most `sample`
    rows = sorted((r["order"], r["label"], *r["x"]) for r in rows)
    x = np.array([r[2:] for r in rows], float).reshape(-1, len(names))
    bad = np.array([r[1] == 0 for r in rows], bool)
    prune = np.array([int(r[0][:8], 16) % 3 == 0 for r in rows], bool)
    return sequential_covering(x, bad, prune, names, **options)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The columns of docs, the statistics, base_failed and kept.

    kept is false where the base rule fails, else the list's verdict. Null and empty texts have no words and fail;
    an empty table gives an empty one; equal rows get equal verdicts.
    """
    out = with_statistics(docs.select(*[c for c in docs.columns if c not in ("base_failed", "kept")])).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.kept(features_of()))
