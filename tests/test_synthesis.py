"""Trees, donors, structure sources, modes."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import derivia as dv
from derivia.operators import cart
from derivia.plans.mode import cart_knobs

EDU = dv.Choice(["HS", "College"], [0.6, 0.4])


def donors():
    return pd.DataFrame({"education": ["HS"] * 300 + ["College"] * 300, "wage": np.r_[np.linspace(20e3, 30e3, 300), np.linspace(80e3, 90e3, 300)]})


def schema(n=2000):
    return dv.Schema([dv.Entity("person", n, {"education": EDU})], [dv.Table("t", "person", {"wage": 0.0}, ["education"])], 7)


def test_tree_splits_exactly():
    x = np.array([[1.0], [2], [3], [10], [11], [12]])
    t = cart.fit(x, np.array([0.0, 0, 0, 5, 5, 5]), None, ["x"], min_leaf=1)
    assert t.feature.tolist() == [0, -1, -1] and t.threshold[0] == 6.5
    t = cart.fit(x, np.array([0, 0, 0, 1, 1, 2]), 3, ["x"], min_leaf=1)
    assert len(t.leaves) == 3 and len(set(t.apply(x)[:3])) == 1
    assert len(cart.fit(x, np.ones(6), None, ["x"], min_leaf=1).leaves) == 1
    assert len(cart.fit(x, np.arange(6.0), None, ["x"], min_leaf=3).leaves) == 2
    assert len(cart.fit(x, np.arange(6.0), None, ["x"], min_leaf=1, max_depth=1).leaves) == 2


@pytest.mark.parametrize("as_spark", [False, True])
def test_conditional_structure_survives(spark, as_spark):
    frame = spark.createDataFrame(donors()) if as_spark else donors()
    s = dv.CARTSynthesizer(["wage"], predictors=["education"], structure=frame)
    r = dv.Pipeline(schema(), synthesizer=s).run()
    lo, hi = (r["t"].filter(F.col("education") == e).agg(F.min("wage"), F.max("wage")).first() for e in ("HS", "College"))
    assert 20e3 <= lo[0] < lo[1] <= 30e3 and 80e3 <= hi[0] < hi[1] <= 90e3
    assert r["t"].join(spark.createDataFrame(donors()).select("wage").distinct(), "wage", "left_anti").count() == 0
    assert s.donor_diagnostics() == {"t": {}} and r.metadata["t"]["synthesize"]["source"] == "Empirical"
    assert sorted(map(tuple, r["t"].collect())) == sorted(map(tuple, dv.Pipeline(schema(), synthesizer=dv.CARTSynthesizer(["wage"], predictors=["education"], structure=frame), partition_rows=97).run()["t"].collect()))


def test_large_tree_uses_batches(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"education": ["HS"] * 6000, "a": rng.uniform(0, 1, 6000), "wage": rng.uniform(0, 1, 6000)})
    sch = dv.Schema([dv.Entity("person", 300)], [dv.Table("t", "person", {"a": dv.Uniform(0, 1), "wage": 0.0})], 7)
    out = dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["wage"], predictors=["a"], structure=frame)).run()["t"]
    assert out.join(spark.createDataFrame(frame).select("wage"), "wage", "left_semi").count() == 300


def test_declared_and_prior(spark):
    sch = dv.Schema([dv.Entity("person", 3000, {"education": EDU})], [dv.Table("t", "person", {"employed": "", "tenure": "own"}, ["education"])], 7)
    cells = {("HS", "yes"): 0.3, ("HS", "no"): 0.3, ("College", "yes"): 0.38, ("College", "no"): 0.02}
    prior = dv.Prior({"education": {"HS": 0.6, "College": 0.4}}, {("education", "employed"): cells}, rows=4000)
    out = dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["employed"], predictors=["education"], structure=prior)).run()["t"]
    share = {r.education: r.s for r in out.groupBy("education").agg(F.avg((F.col("employed") == "yes").cast("int")).alias("s")).collect()}
    assert abs(share["HS"] - 0.5) < 0.06 and abs(share["College"] - 0.95) < 0.04
    assert dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["tenure"])).run()["t"].filter("tenure <> 'own'").count() == 0
    out = dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["tenure"], structure={"tenure": {"own": 0.65, "rent": 0.35}})).run()["t"]
    assert abs(out.filter("tenure = 'own'").count() / 3000 - 0.65) < 0.04


def test_fit_cap_and_ordering(spark):
    frame = spark.createDataFrame(donors())
    s = dv.CARTSynthesizer(["wage"], structure=frame, fit_cap=100)
    facts = dv.Pipeline(schema(), synthesizer=s).run().metadata["t"]["synthesize"]
    assert facts["sampled"] and 50 < facts["fit_rows"] <= 100


def test_chain_query_draws_from_all_donors(spark, tmp_path):
    from derivia import queries
    from derivia.functions.derive import hash_key

    rows = 21_000
    i = np.arange(rows)
    flag, status = i % 3, (i % 7 < 1 + 2 * (i % 3)).astype(int)
    frame = pd.DataFrame({"l_orderkey": i // 4 + 1, "l_linenumber": i % 4 + 1, "l_returnflag": np.array(["A", "N", "R"])[flag], "l_linestatus": np.array(["F", "O"])[status], "l_quantity": 1e6 * flag + 3e5 * status + i})
    spark.createDataFrame(frame).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(400)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")

    def draw(key, column, digits):
        return int(hashlib.md5((hash_key(queries.SEED, f"synth\0t\0{column}") + key).encode()).hexdigest()[:digits], 16)

    def donated(group, key, column):
        return group[column].iloc[int(draw(key, column, 13) / 2**52 * len(group))]

    flags, pairs = dict(tuple(frame.groupby("l_returnflag"))), dict(tuple(frame.groupby(["l_returnflag", "l_linestatus"])))
    want = []
    for key in (f"person:{k}" for k in range(400)):
        f = frame["l_returnflag"].iloc[draw(key, "l_returnflag", 16) % rows]
        s = donated(flags[f], key, "l_linestatus")
        want.append((f, s, donated(pairs[f, s], key, "l_quantity")))
    assert sorted(map(tuple, queries.QUERIES["cart_chain"](spark, str(tmp_path)).collect())) == sorted(want)


def test_text_numbers_and_nulls(spark):
    frame = pd.DataFrame({"education": ["HS", None, "College"] * 40, "amount": [str(i) for i in range(120)]})
    sch = dv.Schema([dv.Entity("person", 200, {"education": EDU})], [dv.Table("t", "person", {"amount": "0"}, ["education"])], 7)
    out = dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["amount"], predictors=["education"], numeric=["amount"], structure=frame)).run()["t"]
    assert dict(out.dtypes)["amount"] == "string" and out.filter("try_cast(amount as int) is null").count() == 0
    frame.loc[0, "amount"] = "refused"
    with pytest.raises(ValueError, match="refused"):
        dv.Pipeline(sch, synthesizer=dv.CARTSynthesizer(["amount"], predictors=["education"], numeric=["amount"], structure=frame)).run()


def test_errors(spark):
    for bad, kind in (
        (lambda: dv.CARTSynthesizer([]), ValueError), (lambda: dv.CARTSynthesizer(["a"], structure="empirical"), dv.StructureConfigError), (lambda: dv.CARTSynthesizer(["a"], structure={"a": 3}), TypeError),
        (lambda: dv.CARTSynthesizer(["a"], structure=3), TypeError), (lambda: dv.Prior({}), ValueError), (lambda: dv.Empirical(pd.DataFrame()), ValueError),
        (lambda: dv.Prior({"a": {1: 1.0}, "b": {2: 1.0}}, {("a", "b"): {(5, 2): 1.0}}), ValueError),
        (lambda: dv.Prior({"a": {1: 1.0}}, {("a", "b"): {(1, 2): 1.0}, ("a", "c"): {(1, 2): 1.0}}), ValueError),
        (lambda: dv.Pipeline(schema(), synthesizer=dv.CARTSynthesizer(["zz"], structure=donors())).run(), KeyError),
        (lambda: dv.Pipeline(schema(), synthesizer=dv.CARTSynthesizer(["wage"], predictors=["zz"])).run(), KeyError),
    ):
        with pytest.raises(kind):
            bad()


def test_synthesizer_conformance(spark):
    dv.check_synthesizer(dv.CARTSynthesizer(["wage"], predictors=["education"], structure=donors()), schema(300), spark=spark)

    class Drops:
        columns = ["wage"]

        def run(self, df, table, ctx):
            return df.limit(5)

    class Touches(Drops):
        def run(self, df, table, ctx):
            return df.withColumn("education", F.lit("x"))

    for bad in (Drops(), Touches()):
        with pytest.raises(dv.SynthesizerConformanceError):
            dv.check_synthesizer(bad, schema(300), spark=spark)


def test_knobs():
    assert cart_knobs(5)["max_depth"] is None and cart_knobs(9)["fit_cap"] == 200_000 and cart_knobs(0.001)["max_depth"] == 1
    assert cart_knobs(1.0)["min_samples_leaf"].value == 100 and cart_knobs(0.01)["fit_cap"] == 1000


def test_modes(spark, tmp_path):
    mode = dv.Mode.metadata(spark)
    e = mode.entity("p", count=200, attributes={"g": mode.attribute("g", values=["a", "b"], missing_rate=0.5), "x": mode.attribute("x", distribution="normal", mean=5, sd=1)})
    out = mode.schema(entities=[e], tables=[mode.table("t", grain="p", carry="*")], seed=1).run()["t"]
    assert 60 < out.filter("g is null").count() < 140
    mode.attribute("lost", values=[1], typo_rate=0.1)
    with pytest.raises(ValueError, match="lost"):
        mode.schema(entities=[e], tables=[mode.table("t", grain="p", carry="*")])
    for bad in ({"values": [1], "missing_rat": 0.1}, {"distribution": "normal", "mean": 1}, {"mean": 1}):
        with pytest.raises(ValueError):
            mode.attribute("b", **bad)
    donors().to_csv(tmp_path / "d.csv", index=False)
    real = dv.Mode.real_data(str(tmp_path / "d.csv"), epsilon=5, spark=spark)
    e = real.entity("p", count=800, attributes={"education": real.attribute("education"), "wage": real.attribute("wage", epsilon=2)})
    r = real.schema(entities=[e], tables=[real.table("t", grain="p", carry="*")], seed=1).run()
    means = {x.education: x.m for x in r["t"].groupBy("education").agg(F.avg("wage").alias("m")).collect()}
    assert 24e3 < means["HS"] < 26e3 and 84e3 < means["College"] < 86e3 and "synthesize.eps2" in r.metadata["t"]
    with pytest.raises(ValueError, match="bound"):
        real.schema(entities=[real.entity("p", count=5, attributes={"other": real.attribute("wage")})], tables=[real.table("t", grain="p", carry="*")])
    for bad in (lambda: dv.Mode.real_data(donors(), epsilon=0), lambda: dv.Mode.real_data("x.json"), lambda: dv.Mode.scope("NY").attribute("a")):
        with pytest.raises(ValueError):
            bad()


def test_scope_fetches_on_run(spark, monkeypatch):
    from derivia.sources import pums

    asked = []
    monkeypatch.setattr(pums, "fetch_pums", lambda s, v, state: asked.append(state) or spark.createDataFrame([(20 + i, 1000 * i) for i in range(60)], "AGEP bigint, PINCP bigint"))
    mode = dv.Mode.scope("NY", spark=spark)
    e = mode.entity("p", count=50, attributes={"age": mode.attribute("age", variable="AGEP"), "income": mode.attribute("income", variable="PINCP")})
    s = mode.schema(entities=[e], tables=[mode.table("t", grain="p", carry="*")])
    assert not asked
    assert s.run()["t"].filter("age < 20").count() == 0 and asked == ["NY"]


def test_sample_of_equal_rows(spark, monkeypatch):
    """Copies are drawn each by itself, whatever way the rows lie, and however many copies one row of a generator holds."""
    from derivia.operators import synthesize

    rows = spark.range(3000).select((F.col("id") % 3).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("w"))
    want, sampled = synthesize.training_sample(rows, 900, 7, "t")
    assert sampled and 800 < len(want) <= 900
    monkeypatch.setattr(synthesize, "COPIES", 7)
    got, _ = synthesize.training_sample(rows.repartition(5), 900, 7, "t")
    assert got.equals(want)
    assert 200 < (want.v == 0).sum() < 400 and (want.w.isna() == (want.v == 0)).all()


@pytest.mark.parametrize("order_by", [["id"], []])
def test_all_rows_are_drawn_from_above_the_default_cap(spark, monkeypatch, order_by):
    """Each row draws from all donors in their order, or in that of their content, many copies and nulls among them; a cap that is given holds."""
    from derivia.functions.derive import hash_key
    from derivia.operators import synthesize

    for name, value in (("FIT_CAP", 60), ("RANGE_ROWS", 90), ("COPIES", 7)):
        monkeypatch.setattr(synthesize, name, value)
    values = [None] * 300 + [5.0] * 900 + [float(v) for v in range(10, 610)]
    shuffled = np.random.default_rng(3).permutation(len(values))
    frame = spark.createDataFrame([(int(i), values[j]) for i, j in enumerate(shuffled)], "id long, wage double").repartition(5)
    ordered = [values[j] for j in shuffled] if order_by else values

    def made(**more):
        structure = dv.Empirical(frame if order_by else frame.select("wage"), order_by=order_by)
        r = dv.Pipeline(schema(500), synthesizer=dv.CARTSynthesizer(["wage"], structure=structure, **more)).run()
        return r.metadata["t"]["synthesize"], [x.wage for x in r["t"].select("wage").collect()]

    def draw(i):
        return int(hashlib.md5((hash_key(7, "synth\0t\0wage") + f"person:{i}").encode()).hexdigest()[:16], 16) % len(values)

    facts, got = made()
    assert sorted(got, key=repr) == sorted((ordered[draw(i)] for i in range(500)), key=repr)
    assert facts["fit_rows"] == 1800 and not facts["sampled"]
    facts, got = made(fit_cap=30)
    assert facts["sampled"] and facts["fit_rows"] <= 30 and len(set(got)) <= 30


def test_chain_draws_from_all_rows_above_the_default_cap(spark, tmp_path, monkeypatch):
    from derivia.operators import synthesize

    monkeypatch.setattr(synthesize, "FIT_CAP", 1000)
    monkeypatch.setattr(synthesize, "RANGE_ROWS", 2000)
    test_chain_query_draws_from_all_donors(spark, tmp_path)


def test_tree_of_all_rows_above_the_default_cap(spark, monkeypatch):
    """A group of two rows in 3,000 has its own leaf and donors: the tree stands on all rows, as no more than the cap differ."""
    from derivia.functions.derive import hash_key
    from derivia.operators import synthesize

    monkeypatch.setattr(synthesize, "FIT_CAP", 40)
    monkeypatch.setattr(synthesize, "RANGE_ROWS", 500)
    rows = [(i, "rare" if i in (1500, 2100) else "HS" if i % 3 else "College", 900 + i % 2 if i in (1500, 2100) else i % 7 + 20 * (i % 3 == 0)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, education string, wage long").repartition(4)
    sch = dv.Schema([dv.Entity("person", 400, {"education": dv.Choice(["HS", "College", "rare"])})], [dv.Table("t", "person", {"wage": 0}, ["education"])], 7)
    cart_ = dv.CARTSynthesizer(["wage"], predictors=["education"], structure=dv.Empirical(frame, order_by=["id"]), min_samples_leaf=1)
    r = dv.Pipeline(sch, synthesizer=cart_).run()
    groups = {e: [w for _, x, w in rows if x == e] for e in ("HS", "College", "rare")}

    def unit(i, salt):
        return int(hashlib.md5((hash_key(7, salt) + f"person:{i}").encode()).hexdigest()[:13], 16) / 2**52

    want = []
    for i in range(400):
        e = ["HS", "College", "rare"][int(unit(i, "entity\0person\0education") * 3)]
        want.append((e, groups[e][int(unit(i, "synth\0t\0wage") * len(groups[e]))]))
    assert sorted((x.education, x.wage) for x in r["t"].collect()) == sorted(want)
    assert r.metadata["t"]["synthesize"]["fit_rows"] == 3000 and not r.metadata["t"]["synthesize"]["sampled"]


def test_weights_stand_for_rows():
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 6, (60, 2)).astype(float), rng.integers(1, 9, 60)
    for y, classes in ((rng.integers(0, 5, 60).astype(float), None), (rng.integers(0, 3, 60), 3)):
        a = cart.fit(x, y, classes, ["p", "q"], min_leaf=4, weights=w)
        b = cart.fit(np.repeat(x, w, axis=0), np.repeat(y, w), classes, ["p", "q"], min_leaf=4)
        assert len(a.leaves) > 3 and a.feature.tolist() == b.feature.tolist() and a.threshold.tolist() == b.threshold.tolist()
