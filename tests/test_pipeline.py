"""Schemas, grains, linkage and sinks from end to end."""

import pytest
from pyspark.sql import functions as F

import derivia as dv

EDU = dv.Choice(["HS", "College"], [0.6, 0.4])


def person(n=400, **more):
    return dv.Entity("person", n, {"education": EDU, "birth_year": dv.Integer(1960, 2005)}, [dv.Identifier("student_id", "S", 9), dv.Identifier("tax_id", digits=9)], **more)


def wages(**more):
    wage = dv.Conditional("education", {"HS": dv.Normal(38000, 5000, low=0), "College": dv.Normal(64000, 8000, low=0)})
    return dv.Table("wages", dv.PerPeriod("person", [2020, 2021, 2022], **more), {"wage": wage}, ["education"], ["tax_id"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(tables, entities=None, seed=42, **options):
    return dv.Pipeline(dv.Schema(entities or [person()], tables, seed), **options).run()


@pytest.mark.parametrize("partition_rows", [13, 97, 100_000])
def test_partitions_change_nothing(spark, partition_rows):
    tables = [wages(presence=0.7), dv.Table("visits", dv.PerEvent("person", 0, 4), {"cost": dv.Uniform(0, 9)}, carry="*", identifiers=["tax_id"])]
    want, got = run(tables), run(tables, partition_rows=partition_rows)
    for name in ("wages", "visits"):
        assert rows(want[name]) == rows(got[name])


def test_seed_and_kernel_change_values(spark):
    base = rows(run([wages()])["wages"])
    assert base == rows(run([wages()])["wages"]) != rows(run([wages()], seed=43)["wages"]) and base != rows(run([wages()], kernel="xxhash64")["wages"])


def test_schema_of_output(spark):
    r = run([dv.Table("roster", "person", carry=["education", "birth_year"], identifiers=["student_id", "tax_id"]), wages()])
    assert r["roster"].dtypes == [("student_id", "string"), ("tax_id", "string"), ("education", "string"), ("birth_year", "bigint")]
    assert r["wages"].dtypes == [("tax_id", "string"), ("period", "bigint"), ("education", "string"), ("wage", "double")]
    assert r.summary().orderBy("table").collect() == [("roster", 400, 4), ("wages", 1200, 4)]
    with pytest.raises(KeyError):
        r["nothing"]


def test_declared_order_survives_dependency_order(spark):
    t = dv.Table("t", "person", {"b": dv.Sequential("a", lambda x: x + 1), "a": 1})
    assert run([t])["t"].columns == ["b", "a"]


def test_ids_and_attributes_agree_across_tables(spark):
    r = run([dv.Table("roster", "person", carry="*", identifiers=["student_id", "tax_id"]), wages()])
    j = r["wages"].alias("w").join(r["roster"].alias("r"), "tax_id")
    assert j.count() == 1200 and j.filter("w.education <> r.education").count() == 0
    assert r["roster"].select("tax_id").distinct().count() == 400
    c = r["roster"].select(F.col("tax_id").cast("double").alias("a"), F.substring("student_id", 2, 9).cast("double").alias("b")).agg(F.corr("a", "b")).first()[0]
    assert abs(c) < 0.1


def test_coverage_presence_and_events(spark):
    r = run([dv.Table("half", "person", carry="*", coverage=0.5), wages(presence=0.5), dv.Table("e", dv.PerEvent("person", 1, 6)), dv.Table("z", dv.PerEvent("person", 0, 3), identifiers=["tax_id"])])
    assert abs(r["half"].count() / 400 - 0.5) < 0.1 and abs(r["wages"].count() / 1200 - 0.5) < 0.1
    assert 400 <= r["e"].count() <= 2000 and r["e"].agg(F.min("occurrence"), F.max("occurrence")).first() == (0, 4)
    assert r["z"].select("tax_id").distinct().count() < 400
    facts = r.metadata["half"]["generate"]
    assert facts["entities_total"] == 400 and facts["entities_covered"] == facts["rows"] == r["half"].count()


def test_period_and_entity_order_are_irrelevant(spark):
    other = dv.Table("wages", dv.PerPeriod("person", [2022, 2020, 2021]), wages().columns, ["education"], ["tax_id"])
    assert rows(run([wages()])["wages"]) == rows(run([other])["wages"])
    firm = dv.Entity("firm", 400, {"education": EDU}, [dv.Identifier("tax_id", digits=9)])
    firms = dv.Table("firms", "firm", carry="*", identifiers=["tax_id"])
    a, b = run([wages(), firms], [person(), firm]), run([wages(), firms], [firm, person()])
    assert rows(a["wages"]) == rows(b["wages"]) and rows(a["firms"]) == rows(b["firms"])
    people = run([dv.Table("p", "person", carry=["education"], identifiers=["tax_id"])])["p"]
    assert people.join(a["firms"], "tax_id").count() < 5


def test_mixed_periods_are_text(spark):
    assert dict(run([dv.Table("t", dv.PerPeriod("person", [2020, "late"]))])["t"].dtypes)["period"] == "string"


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_run_to(spark, tmp_path, format):
    r = dv.Pipeline(dv.Schema([person(5)], [wages(), dv.Table("none", "person", {"score": dv.Integer(0, 9)}, coverage=1e-9)], 4)).run_to(str(tmp_path), format=format)
    assert r.metadata["wages"]["output"]["rows"] == 15 and r.metadata["none"]["output"]["rows"] == 0 and not r.tables
    if format == "parquet":
        assert spark.read.parquet(r.paths["none"]).dtypes == [("score", "bigint")]
    with pytest.raises(ValueError):
        dv.Pipeline(dv.Schema([person()], [wages()])).run_to(str(tmp_path), format="orc")


def test_ordered_and_stream(spark):
    p = dv.Pipeline(dv.Schema([dv.Entity("person", 50, {}, [dv.Identifier("i", digits=6)])], [dv.Table("t", dv.PerPeriod("person", [2, 1]), identifiers=["i"])], 1))
    got = p.run(ordered=True)["t"].collect()
    assert [r.period for r in got] == [2, 1] * 50 and sum(1 for _ in p.stream("t").toLocalIterator()) == 100


@pytest.mark.parametrize("schema", [
    lambda: dv.Schema([], [wages()]),
    lambda: dv.Schema([person()], []),
    lambda: dv.Schema([person(), person()], [wages()]),
    lambda: dv.Schema([person()], [wages(), wages()]),
    lambda: dv.Schema([dv.Entity("person", 3, {"_dv_x": 1})], [dv.Table("t", "person")]),
    lambda: dv.Schema([dv.Entity("person", 3, {"a": dv.Sequential("a2", lambda x: x)})], [dv.Table("t", "person")]),
    lambda: dv.Schema([person()], [dv.Table("t", "firm")]),
    lambda: dv.Schema([person()], [dv.Table("t", "person", carry=["x"])]),
    lambda: dv.Schema([person()], [dv.Table("t", "person", identifiers=["x"])]),
    lambda: dv.Schema([person()], [dv.Table("t", "person", {"education": 1}, ["education"])]),
    lambda: dv.Schema([person()], [dv.Table("t", "person", {"tax_id": 1}, identifiers=["tax_id"])]),
    lambda: dv.Schema([person()], [dv.Table("t", dv.PerPeriod("person", [1]), {"period": 1})]),
    lambda: dv.Schema([dv.Entity("person", 10**6, {}, [dv.Identifier("t", digits=11)])], [dv.Table("t", "person")]),
])
def test_schema_errors(spark, schema):
    with pytest.raises(dv.SchemaError):
        dv.Pipeline(schema())


def test_width_advice():
    with pytest.raises(dv.SchemaError, match="at least 12 digits"):
        dv.Pipeline(dv.Schema([dv.Entity("p", 10**6, {}, [dv.Identifier("t", digits=10)])], [dv.Table("t", "p")]))
    with pytest.raises(dv.SchemaError, match="split"):
        dv.Pipeline(dv.Schema([dv.Entity("p", 10**10, {}, [dv.Identifier("t", digits=18)])], [dv.Table("t", "p")]))


def test_value_errors():
    for bad in (
        lambda: dv.Identifier(""), lambda: dv.Identifier("t", digits=0), lambda: dv.Entity("p", 0), lambda: dv.Entity("p", 1, {}, ["a", "a"]), lambda: dv.PerPeriod("p", []),
        lambda: dv.PerPeriod("p", [1, 1]), lambda: dv.PerPeriod("p", [1], presence=0), lambda: dv.PerEvent("p", -1, 2), lambda: dv.PerEvent("p", 2, 2), lambda: dv.Table("t", "p", coverage=1.5),
        lambda: dv.Pipeline(dv.Schema([person()], [wages()]), partition_rows=0), lambda: dv.Schema([person()], [dv.Table("t", "x", carry="*")]),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        dv.Schema([person()], [wages()]).table("x")


def test_provenance(spark):
    r = run([dv.Table("t", "person", coverage=dv.cited(0.5, "a study"))])
    assert r.provenance["t.coverage"].origin == "cited" and "person.count" in r.provenance and not r.unjustified()
    for bad in (lambda: dv.cited(1, " "), lambda: dv.Tagged(1, "guessed")):
        with pytest.raises(ValueError):
            bad()


def test_registry():
    @dv.register("noiser", "mine")
    class Mine:
        pass

    assert isinstance(dv.resolve("noiser", "mine"), Mine) and "mine" in dv.available("noiser")
    with pytest.raises(ValueError):
        dv.register("noiser", "mine")(Mine)
    dv.unregister("noiser", "mine")
    for bad in (lambda: dv.unregister("noiser", "mine"), lambda: dv.resolve("noiser", "mine"), lambda: dv.available("x")):
        with pytest.raises(KeyError):
            bad()


def test_conformance(spark):
    schema = dv.Schema([person()], [dv.Table("r", "person", carry="*")], 1)
    dv.check_generator(dv.RuleGenerator(), schema, spark=spark)

    class Random(dv.RuleGenerator):
        def emit(self, table, ctx):
            return super().emit(table, ctx).withColumn("education", F.rand().cast("string"))

    class Short(dv.RuleGenerator):
        def emit(self, table, ctx):
            return super().emit(table, ctx).filter("_dv_index > 3")

    for bad in (Random(), Short()):
        with pytest.raises(dv.GeneratorConformanceError):
            dv.check_generator(bad, schema, spark=spark)
    with pytest.raises(ValueError):
        dv.check_generator(dv.RuleGenerator(), dv.Schema([dv.Entity("person", 1)], [dv.Table("r", "person")]), spark=spark, split_rows=10**6)


def test_no_shuffle_in_generation(spark, capsys):
    run([wages()])["wages"].explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan


def test_checks_read_many_partitions_by_few_tasks(spark):
    """A partition for every entity is checked as it is, yet no stage has a task for each."""
    schema = dv.Schema([dv.Entity("person", 1500, {"education": dv.Choice(["HS", "College"])})], [dv.Table("roster", "person", carry="*")], 3)
    context = spark.sparkContext
    context.setJobGroup("many partitions", "")
    try:
        dv.check_generator(dv.RuleGenerator(), schema, spark=spark, split_rows=1)
        dv.check_synthesizer(Late(), schema, spark=spark, split_rows=1000)
        with pytest.raises(dv.GeneratorConformanceError, match="partitions"):
            dv.check_generator(LateRows(), schema, spark=spark, split_rows=1)
        with pytest.raises(dv.SynthesizerConformanceError, match="partitions"):
            dv.check_synthesizer(Late(), schema, spark=spark, split_rows=1)
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many partitions") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) < 100
    finally:
        context.setJobGroup("", "")


class Late:
    """Another value in the partitions from the thousandth on, so only where none of them have been put together."""

    columns = ("education",)

    def run(self, df, table, ctx):
        return df.withColumn("education", F.when(F.spark_partition_id() < 1000, F.col("education")).otherwise("late"))


class LateRows(dv.RuleGenerator):
    def emit(self, table, ctx):
        return Late().run(super().emit(table, ctx), table, ctx)
