"""Derivation and rules."""

import math
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

import derivia as dv
from derivia.functions import derive
from derivia.functions.rules import PoolChoice, coerce_rule, resolve_order


def keys(spark, n, parts=3):
    return spark.range(n).repartition(parts).select("id", F.concat(F.lit("person:"), F.col("id").cast("string")).alias("key"))


def values(df, rule, salt="s", seed=1):
    return {r.id: r.v for r in rule.attach(df, "v", "key", seed, salt).select("id", "v").collect()}


@pytest.mark.parametrize("kernel", derive.KERNELS)
def test_units_reach_and_separate(spark, kernel):
    with derive.using_kernel(kernel):
        u, w = derive.unit(F.col("key"), 7, "height"), derive.unit(F.col("key"), 7, "weight")
        r = keys(spark, 5000).select(u.alias("u"), w.alias("w")).agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "w")).first()
    assert 0 <= r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.02 and abs(r[3]) < 0.05


def test_normal_moments(spark):
    r = keys(spark, 20000).select(derive.normal(F.col("key"), 7, "h", 170, 10).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(r[0] - 170) < 0.5 and abs(r[1] - 10) < 0.5


def test_ids_spread_and_repeat(spark):
    df = keys(spark, 2000).select(dv.derive_id(F.col("key"), 3, "t", digits=10).alias("id"))
    assert df.distinct().count() == 2000 and df.filter(F.length("id") != 10).count() == 0
    with pytest.raises(ValueError):
        dv.derive_id(F.col("key"), 3, "t", digits=19)


def test_weighted_pick_shares_and_zero_weights(spark):
    got = values(keys(spark, 5000), dv.Choice(["a", "b", "c"], [0.6, 0.0, 0.4]))
    share = sum(v == "a" for v in got.values()) / 5000
    assert abs(share - 0.6) < 0.03 and "b" not in got.values()


def test_pool_pick_agrees_with_choice_over_sorted_values(spark):
    pool = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "value string, weight double")
    assert values(keys(spark, 300), PoolChoice(pool)) == values(keys(spark, 300), dv.Choice(["a", "b", "c"], [1, 2, 3]))


@pytest.mark.parametrize("weights", [[1, -1], [0, 0], [math.nan, 1], [math.inf, 1]])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        derive.checked_weights(2, weights)


def test_construction_errors():
    for bad in (lambda: dv.Choice([]), lambda: dv.Choice([1], [1, 2]), lambda: dv.Integer(5, 5), lambda: dv.Uniform(2, 1), lambda: dv.Conditional("a", {})):
        with pytest.raises(ValueError):
            bad()


def test_coercions():
    import numpy as np

    assert coerce_rule([1, 2]) == dv.Choice([1, 2]) and coerce_rule(3) == dv.Constant(3) and coerce_rule(np.int64(4)) == dv.Constant(4)
    for bad in (namedtuple("P", "x y")(1, 2), {1}, None, object()):
        with pytest.raises(TypeError):
            coerce_rule(bad)


def test_types():
    assert dv.Choice([1, 2.5]).spark_type() == "double" and dv.Choice([True, 2]).spark_type() == "bigint" and dv.Choice([1, "x"]).spark_type() == "string"
    assert dv.Conditional("a", {1: 2, 2: dv.Normal(0, 1)}).spark_type() == "double"


def test_conditional_without_default_names_the_value(spark):
    df = keys(spark, 4).withColumn("g", F.when(F.col("id") < 3, "x").otherwise("zz"))
    with pytest.raises(Exception, match="zz"):
        values(df, dv.Conditional("g", {"x": 1}))
    assert set(values(df, dv.Conditional("g", {"x": 1}, default=9)).values()) == {1, 9}


def test_conditional_nulls_match_nothing(spark):
    df = keys(spark, 2).withColumn("g", F.lit(None).cast("double"))
    assert set(values(df, dv.Conditional("g", {float("nan"): 1}, default=2)).values()) == {2}
    with pytest.raises(ValueError, match="lacks"):
        values(keys(spark, 2), dv.Conditional("g", {1: 1}))


def test_order():
    rules = {"c": dv.Sequential("b", lambda x: x), "b": dv.Sequential("a", lambda x: x), "a": dv.Constant(1)}
    assert resolve_order(rules) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        resolve_order({"a": dv.Sequential("b", lambda x: x), "b": dv.Sequential("a", lambda x: x)})
    with pytest.raises(ValueError, match="not available"):
        resolve_order({"a": dv.Sequential("x", lambda x: x)})


def test_sequential_in_pandas(spark):
    import pandas as pd

    def double(x: pd.Series) -> pd.Series:
        return x * 2

    assert values(keys(spark, 5), dv.Sequential("id", double, returns="bigint")) == {i: 2 * i for i in range(5)}


def test_check_rule(spark):
    dv.check_rule(dv.Normal(0, 1), spark)

    class Bad(dv.Rule):
        def column(self, key, seed, salt, env):
            return F.rand()

    with pytest.raises(dv.RuleConformanceError):
        dv.check_rule(Bad(), spark)
