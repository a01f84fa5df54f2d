"""Statistics over real and synthetic frames, and reference data."""

import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import derivia as dv
from derivia.operators import fidelity
from derivia.sources import fetch, people, pums
from derivia.sources.files import load_source


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    real = pd.DataFrame({"amount": rng.normal(size=500), "sector": rng.choice(list("abc"), 500), "flag": rng.random(500) < 0.5})
    real["twice"] = 2 * real.amount + rng.normal(size=500) / 10
    real["kind"] = real.sector.map({"a": "x", "b": "x", "c": "y"})
    far = real.assign(amount=real.amount + 6, kind=rng.choice(list("xy"), 500))
    return spark.createDataFrame(real), spark.createDataFrame(far), real, far


def test_report(frames):
    real, far, *_ = frames
    same = dv.fidelity_report(real, real, ["amount", "sector", "twice", "kind"], thresholds={"ks_pvalue": 0.05, "category_share_delta": 0.1, "association_delta": 0.05})
    assert all(r.passed for r in same.to_frame().collect()) and all(r.delta == 0 for r in same.associations.collect())
    other = dv.fidelity_report(far, real, ["amount", "kind", "sector"], thresholds={"ks_pvalue": 0.05, "association_delta": 0.05})
    stats = {r.column: r for r in other.column_stats.collect()}
    assert stats["amount"].passed is False and stats["amount"].pvalue < 1e-9 and stats["kind"].passed is None
    assert any(r.passed is False for r in other.associations.collect() if r.metric == "cramers_v")


def test_statistics_against_numpy(spark, frames):
    real, far, r, f = frames
    grid = np.sort(np.r_[r.amount, f.twice])
    want = np.abs(np.searchsorted(np.sort(r.amount), grid, "right") / 500 - np.searchsorted(np.sort(f.twice), grid, "right") / 500).max()
    s, n, m = fidelity.ks(real, far.withColumn("amount", F.col("twice")), "amount").first()
    assert abs(s - want) < 1e-12 and (n, m) == (500, 500)
    assert abs(fidelity.pearson(real, "amount", "twice").first()[0] - np.corrcoef(r.amount, r.twice)[0, 1]) < 1e-9
    tab = pd.crosstab(r.sector, r.kind).to_numpy()
    e = tab.sum(1, keepdims=True) * tab.sum(0) / tab.sum()
    assert abs(fidelity.cramers_v(real, "sector", "kind").first()[0] - math.sqrt(((tab - e) ** 2 / e).sum() / tab.sum())) < 1e-9
    g = r.groupby("sector").amount
    eta = math.sqrt((g.size() * (g.mean() - r.amount.mean()) ** 2).sum() / ((r.amount - r.amount.mean()) ** 2).sum())
    assert abs(fidelity.correlation_ratio(real, "sector", "amount").first()[0] - eta) < 1e-9


def test_undefined_statistics_are_null(spark):
    df = spark.createDataFrame([(1.0, "a", None), (1.0, "a", None)], "x double, c string, n double")
    assert fidelity.pearson(df, "x", "x").first()[0] is None and fidelity.cramers_v(df, "c", "c").first()[0] is None
    assert fidelity.correlation_ratio(df, "c", "x").first()[0] is None and fidelity.ks(df, df.filter("false"), "x").first()[0] is None
    r = dv.fidelity_report(df, df, ["n", "x"], thresholds={"ks_pvalue": 0.5}).column_stats.collect()
    assert r[0].value is None and r[0].passed is None and r[1].passed is True


def test_ks_pvalue():
    # By counting: of the C(4,2)=6 paths of 2 and 2 values, two reach a difference of 1, all reach 1/2.
    assert abs(fidelity.ks_pvalue(1.0, 2, 2) - 1 / 3) < 1e-12 and fidelity.ks_pvalue(0.5, 2, 2) == 1.0 and fidelity.ks_pvalue(0.0, 5, 5) == 1.0
    exact, limit = fidelity.ks_pvalue(0.03, 9000, 9000), fidelity.ks_pvalue(0.03, 10_001, 8200)
    assert abs(exact - limit) < 0.002


def test_report_errors(frames):
    real, far, *_ = frames
    for bad, kind in ((lambda: dv.fidelity_report(real, far, []), ValueError), (lambda: dv.fidelity_report(real, far, ["zz"]), KeyError), (lambda: dv.fidelity_report(real, far, ["amount"], synthesizer=3), TypeError)):
        with pytest.raises(kind):
            bad()


def test_states():
    assert pums.resolve_state("36") == pums.resolve_state("NY") == pums.resolve_state("new york") == "36" and pums.resolve_state("6") == "06"
    for bad in ("99", "ZZ", "Atlantis"):
        with pytest.raises(ValueError):
            pums.resolve_state(bad)


def test_pums(spark, tmp_path, monkeypatch):
    payload = [["AGEP", "PINCP", "NAICS"], ["19", "3.5", "1"], ["56", "0", "N"]]
    assert pums.parse_pums(spark, payload, ["AGEP", "PINCP", "NAICS"]).dtypes == [("AGEP", "bigint"), ("PINCP", "double"), ("NAICS", "string")]
    with pytest.raises(RuntimeError):
        pums.parse_pums(spark, payload[:1], ["AGEP"])
    monkeypatch.delenv("CENSUS_API_KEY", raising=False)
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".git").mkdir()
    with pytest.raises(RuntimeError, match="CENSUS_API_KEY"):
        pums.fetch_pums(spark, ["AGEP"], "NY")
    (tmp_path / ".env").write_text("# c\nCENSUS_API_KEY=secret\n")
    calls = []
    monkeypatch.setattr(pums, "fetch_url", lambda url, **k: calls.append(k["request_url"]) or json.dumps(payload).encode())
    for _ in range(2):
        assert pums.fetch_pums(spark, ["AGEP"], "NY", cache_dir=tmp_path / "c").count() == 2
    assert len(calls) == 1 and "secret" in calls[0]
    monkeypatch.setattr(pums, "fetch_url", lambda url, **k: b"<html>")
    with pytest.raises(RuntimeError, match="JSON"):
        pums.fetch_pums(spark, ["AGEP"], "NJ", cache_dir=tmp_path / "c")


def test_fetch_hides_the_secret():
    with pytest.raises(RuntimeError) as e:
        fetch.fetch_url("http://127.0.0.1:9/x", request_url="http://127.0.0.1:9/x?key=secret", label="thing")
    assert "thing" in str(e.value) and "secret" not in str(e.value)


def test_files(spark, tmp_path):
    tsv = "US\t99553\tAkutan\tAlaska\tAK\t\t\t\t\t54.1\t-165.7\t1\nUS\t10001\t\"New York\tNew York\tNY\t\t\t\t\t40.7\t-73.9\t4\n"
    (tmp_path / "US.txt").write_text(tsv)
    places = people.postal_data(spark, tmp_path / "US.txt")
    assert places.count() == 2 and places.filter("city = '\"New York'").count() == 1
    for year, line in ((1900, "Mary,F,400\nJohn,M,350\n"), (2020, "Noah,M,300\n")):
        (tmp_path / f"yob{year}.txt").write_text(line)
    with zipfile.ZipFile(tmp_path / "names.zip", "w") as z:
        for y in (1900, 2020):
            z.write(tmp_path / f"yob{y}.txt", f"yob{y}.txt")
    names = people.yearly_names(spark, tmp_path / "names.zip", tmp_path / "cache")
    assert {tuple(r) for r in names.collect()} == {(1900, "Mary", "F", 400), (1900, "John", "M", 350), (2020, "Noah", "M", 300)}
    (tmp_path / "s.csv").write_text("name,rank,count,prop100k,cum_prop100k,pctwhite,pctblack,pctapi,pctaian,pct2prace,pcthispanic\nSMITH,1,100,1,1,70,20,1,1,1,(S)\nALL OTHER NAMES,0,9,1,1,1,1,1,1,1,1\n")
    assert [tuple(r) for r in people.surnames(spark, tmp_path / "s.csv").select("name", "count", "pcthispanic").collect()] == [("SMITH", 100, 0.0)]
    with pytest.raises(ValueError):
        load_source(spark, "x.json")


def test_people_rules(spark):
    keys = spark.range(400).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, 1900).otherwise(2020).alias("birth_year"), F.lit("M").alias("sex"))
    names = spark.createDataFrame([(1900, "Mary", "F", 400), (1900, "John", "M", 350), (2020, "Noah", "M", 300)], "year int, name string, sex string, count long")
    out = people.SSAFirstName(source=names, sex_on="sex").attach(keys, "v", "key", 1, "s")
    assert {(r.birth_year, r.v) for r in out.collect()} == {(1900, "John"), (2020, "Noah")} and out.columns == ["key", "birth_year", "sex", "v"]
    with pytest.raises(Exception, match="1850"):
        people.SSAFirstName(source=names).attach(keys.withColumn("birth_year", F.lit(1850)), "v", "key", 1, "s").collect()
    ssn = people.SSN().attach(keys, "v", "key", 1, "s")
    assert ssn.filter(~F.col("v").rlike(r"^(?!666|000|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$")).count() == 0
    assert {r.v for r in people.Name("last_name", {"A": 1, "B": 2}).attach(keys, "v", "key", 1, "s").collect()} == {"A", "B"}
    for bad in ({}, {"A": -1}, {"A": float("nan")}, {1: 1}, ["A"]):
        with pytest.raises(RuntimeError):
            people.Name("last_name", bad)
    for bad in (lambda: people.Name("x", {"A": 1}), lambda: people.USAddress("planet", places=keys), lambda: people.Surname("r", {}), lambda: people.Surname("r", {"a": "pctx"})):
        with pytest.raises(ValueError):
            bad()


def test_streaming_agrees_with_batch(spark, tmp_path):
    from derivia import streaming

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(200).select("id", F.lit("Smith").alias("name")).write.parquet(src)

    def prepare(df):
        df = df.withColumn("key", streaming.row_key("person", "id"))
        df = streaming.with_columns(df, "key", {"wage": dv.Normal(10, 1)}, 1, "t")
        df = streaming.with_noise(df, "key", {"name": [dv.Typo(0.5)]}, 1, "t")
        return streaming.with_ids(df, F.col("key"), {"tax_id": ("person\0tax_id", 9)}, 1)

    for _ in range(2):  # a second run finds nothing new
        streaming.run_available(spark.readStream.schema("id long, name string").parquet(src), out, str(tmp_path / "cp"), prepare)
    want = prepare(spark.read.parquet(src))
    got = spark.read.parquet(out).select(*want.columns)
    assert got.count() == 200 and want.exceptAll(got).isEmpty()


def test_ks_with_outliers_and_ties(spark, monkeypatch):
    from derivia.operators import fidelity

    rng = np.random.default_rng(3)
    a = np.r_[rng.normal(size=800), 1e300, -1e300, np.zeros(200)]
    b = np.r_[rng.normal(0.3, 1, 700), np.zeros(50), 1e-300]
    grid = np.unique(np.r_[a, b])
    want = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
    frames = [spark.createDataFrame([(float(x),) for x in v], "v double") for v in (a, b)]
    for ranges in (2, 256):
        monkeypatch.setattr(fidelity, "KS_RANGES", ranges)
        s, n, m = fidelity.ks(*frames, "v").first()
        assert abs(s - want) < 1e-12 and (n, m) == (len(a), len(b))
