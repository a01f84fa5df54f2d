"""Corruption."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import derivia as dv
from derivia.operators.noise import CONFUSED, NEIGHBOURS, corrupted

NAMES = ["北京市", "Ωμέγα", "Ünüver(", "Smith", "aa", "q", "", None, "A😀b"]


def frame(spark, n=4000):
    names = F.array(*[F.lit(x) for x in NAMES])
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("_dv_row"), F.get(names, (F.col("id") % len(NAMES)).cast("int")).alias("v"), (F.col("id") % 2 == 0).alias("even"))


def pairs(spark, op, n=4000):
    df = frame(spark, n)
    out, _ = corrupted(df.withColumn("old", F.col("v")), "v", op, 1, "noise\0t")
    return out.select("old", "v", "even").collect()


def test_typo_is_one_edit_on_every_script(spark):
    got = pairs(spark, dv.Typo(0.5))
    for name in NAMES:
        mine = [r.v for r in got if r.old == name]
        if not name:
            assert set(mine) == {name}
            continue
        changed = [v for v in mine if v != name]
        assert 0.4 < len(changed) / len(mine) < 0.6
        for v in changed:
            if len(v) == len(name):
                at = [i for i in range(len(v)) if v[i] != name[i]]
                near = len(at) == 1 and v[at[0]].lower() in NEIGHBOURS.get(name[at[0]].lower(), "") and v[at[0]].isupper() == name[at[0]].isupper()
                assert near or (len(at) == 2 and at[1] == at[0] + 1 and v[at[0]] == name[at[1]] and v[at[1]] == name[at[0]])
            else:
                assert len(v) == len(name) + 1 and any(name[: i + 1] + name[i:] == v for i in range(len(name)))


def test_ocr(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("_dv_row"), F.lit("B0xl").alias("v"))
    got = {r.v for r in corrupted(df, "v", dv.OCR(1.0), 1, "s")[0].collect()}
    assert got == {"80xl", "BOxl", "B0x1"} and set(CONFUSED) >= {"B", "0", "l"}
    plain = df.withColumn("v", F.lit("xyz"))
    assert {r.v for r in corrupted(plain, "v", dv.OCR(1.0), 1, "s")[0].collect()} == {"xyz"}


def test_missing_rates(spark):
    got = pairs(spark, dv.Missing(lambda row: F.when(row["even"], 0.5).otherwise(0.0)))
    assert not any(r.v is None and r.old is not None for r in got if not r.even)
    even = [r for r in got if r.even and r.old is not None]
    assert abs(sum(r.v is None for r in even) / len(even) - 0.5) < 0.05


@pytest.mark.parametrize("rate", [lambda row: F.lit(1.5), lambda row: F.lit(float("nan")), lambda row: F.lit(None)])
def test_bad_row_rates_fail(spark, rate):
    with pytest.raises(Exception, match="rate"):
        pairs(spark, dv.Missing(rate), 20)


@pytest.mark.parametrize("rate", [lambda row: F.avg(F.col("even").cast("int")), lambda row: 0.5])
def test_rates_must_be_row_wise_columns(spark, rate):
    with pytest.raises(ValueError):
        pairs(spark, dv.Missing(rate), 20)


def test_rates_may_use_columns_of_any_name(spark):
    df = spark.range(40).select(F.concat(F.lit("k"), "id").alias("_dv_row"), F.col("id").alias("v"), (F.col("id") % 2 == 0).alias("Window_open"), F.lit(1).alias("Aggregate [x]"))
    rate = lambda row: F.when(row["Window_open"], row["Aggregate [x]"]).otherwise(0)
    out, _ = corrupted(df, "v", dv.Missing(rate), 1, "salt")
    assert out.filter("v is null").count() == 20


@pytest.mark.parametrize("rate", [lambda row: F.rank().over(Window.orderBy(row["v"])) / 100, lambda row: F.avg(row["v"]), lambda row: F.explode(F.array(row["v"]))])
def test_rates_over_other_rows_are_refused_by_name(spark, rate):
    schema = dv.Schema([dv.Entity("person", 20)], [dv.Table("wages", "person", {"v": dv.Uniform(0, 1)})], 1)
    with pytest.raises(ValueError, match="wages.v"):
        dv.Pipeline(schema, noiser=dv.Noise({"wages": {"v": [dv.Missing(rate)]}})).run()


@pytest.mark.parametrize(("rate", "says"), [(1.5, "out of"), (float("nan"), "no number"), (None, "no number")])
def test_bad_rates_name_table_and_column(spark, rate, says):
    schema = dv.Schema([dv.Entity("person", 20)], [dv.Table("wages", "person", {"v": dv.Uniform(0, 1)})], 1)
    noise = dv.Noise({"wages": {"v": [dv.Missing(lambda row: F.lit(rate))]}})
    with pytest.raises(Exception, match=f"missing on wages.v must give numbers from 0 to 1; here it is {says}"):
        dv.Pipeline(schema, noiser=noise).run()["wages"].collect()


def test_rate_range():
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            dv.Typo(bad)


def test_in_a_pipeline(spark):
    e = dv.Entity("person", 20_000, {"n": dv.Integer(0, 99)}, [dv.Identifier("tax_id", digits=12)])
    noise = dv.Noise({"t": {"n": [dv.Missing(0.3), dv.Missing(0.1)], "tax_id": [dv.OCR(0.2)]}})
    r = dv.Pipeline(dv.Schema([e], [dv.Table("t", "person", carry="*", identifiers=["tax_id"])], 42), noiser=noise).run()
    assert dict(r["t"].dtypes) == {"tax_id": "string", "n": "bigint"}
    assert abs(r["t"].filter("n is null").count() / 20_000 - 0.3) < 0.01  # of one class the lower rate hits some of the same rows
    facts = r.metadata["t"]["noise"]
    assert abs(facts["tax_id.ocr"] - 0.2) < 0.01
    with pytest.raises(KeyError):
        dv.Pipeline(dv.Schema([e], [dv.Table("t", "person")], 1), noiser=dv.Noise({"t": {"zz": [dv.Missing(0.1)]}})).run()


def test_custom_operation(spark):
    class Shout(dv.NoiseOp):
        def corrupt(self, value, key, seed, salt):
            return F.upper(value)

    assert {r.v for r in pairs(spark, Shout(1.0), 90) if r.old == "Smith"} == {"SMITH"}
