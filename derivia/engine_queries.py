"""More queries: sources, sinks, plug-ins, checks and modes over the driver's tables; they join those of `queries`."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import derivia as dv
from derivia import streaming
from derivia.functions import derive
from derivia.functions.rules import coerce_rule
from derivia.operators import fidelity
from derivia.operators.noise import Missing, Noise, Typo
from derivia.operators.synthesize import CARTSynthesizer, ChainedSynthesizer
from derivia.plans.mode import cart_knobs
from derivia.plans.schema import ENTITY_KEY, INDEX, MAX_DIGITS, ORDINAL, ROW_KEY
from derivia.queries import (
    E_TAX, EDU, N, P, S_TAX, SEED, _PANEL, C, _customer_entity, _customers, _person, _pool_sql, _rounded, _run, _table, _WAGE, query, s_cov, s_edu, s_hit, s_id, s_int, s_pick, s_prior, s_typo, s_unit, s_u64, s_wage,
)
from derivia.sources import fetch, files, people, pums

Z = "\0"
S_BIRTH = s_int(P, f"entity{Z}person{Z}birth_year", 1960, 2005)


def _folder(spark) -> str:
    """A fresh folder that all executors see: below the checkpoint folder, on one machine a temporary one."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/derivia-{uuid.uuid4().hex}"


def _refusal(make, *kinds) -> str:
    """The kind of error that a declaration meets, '' for none."""
    try:
        make()
    except kinds as e:
        return type(e).__name__
    return ""


# ---- Sinks and files -----------------------------------------------------------------------------------------------


def _roster(spark, d, **more):
    return dv.Schema([_person(spark, d)], [dv.Table("roster", "person", carry="*", identifiers=["tax_id"]), *more.pop("tables", ())], SEED)


_ROSTER = f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education, {S_BIRTH} AS birth_year FROM {N}"


@query(_ROSTER)
def sink_parquet(spark, d):
    paths = dv.Pipeline(_roster(spark, d), spark=spark).run_to(_folder(spark)).paths
    return files.load_source(spark, paths["roster"])


@query(_ROSTER)
def sink_csv(spark, d):
    """Written with a header and read back by its suffix; digits of identifiers come back as numbers, so they are filled up again."""
    paths = dv.Pipeline(_roster(spark, d), spark=spark).run_to(_folder(spark), format="csv").paths
    read = files.load_source(spark, paths["roster"])
    return read.select(F.lpad(F.col("tax_id").cast("string"), 12, "0").alias("tax_id"), "education", F.col("birth_year").cast("bigint").alias("birth_year"))


@query(f"SELECT 'roster' AS \"table\", (SELECT count(*) FROM {N})::BIGINT AS n UNION ALL SELECT 'half', count(*) FROM {N} WHERE {s_cov('half', 0.5)} UNION ALL SELECT 'none', count(*) FROM {N} WHERE {s_cov('none', 1e-9)}")
def sink_row_counts(spark, d):
    """Rows that run_to reports; an empty table is written too."""
    more = [dv.Table("half", "person", identifiers=["tax_id"], coverage=0.5), dv.Table("none", "person", {"score": dv.Integer(0, 9)}, coverage=1e-9)]
    facts = dv.Pipeline(_roster(spark, d, tables=more), spark=spark).run_to(_folder(spark)).metadata
    return spark.createDataFrame([(t, facts[t]["output"]["rows"]) for t in ("roster", "half", "none")], "table string, n bigint")


@query(f"SELECT 'score' AS name, 'bigint' AS kind, count(*)::BIGINT AS n FROM {N} WHERE {s_cov('none', 1e-9)} UNION ALL SELECT 'weight', 'double', count(*) FROM {N} WHERE {s_cov('none', 1e-9)}")
def sink_empty_table(spark, d):
    """An empty table keeps its columns and types in Parquet."""
    t = dv.Table("none", "person", {"score": dv.Integer(0, 9), "weight": dv.Uniform(0, 1)}, coverage=1e-9)
    back = spark.read.parquet(dv.Pipeline(dv.Schema([_person(spark, d)], [t], SEED), spark=spark).run_to(_folder(spark)).paths["none"])
    return spark.createDataFrame([(*column, back.count()) for column in back.dtypes], "name string, kind string, n bigint")


@query("SELECT f AS format, CASE WHEN f IN ('parquet', 'csv') THEN '' ELSE 'ValueError' END AS error FROM (SELECT unnest(['parquet', 'csv', 'orc', 'json', 'PARQUET']) AS f)")
def sink_formats(spark, d):
    schema = dv.Schema([dv.Entity("person", 3)], [dv.Table("t", "person", {"v": 1})], SEED)
    tried = [(f, _refusal(lambda f=f: dv.Pipeline(schema, spark=spark).run_to(_folder(spark), format=f), ValueError)) for f in ("parquet", "csv", "orc", "json", "PARQUET")]
    return spark.createDataFrame(tried, "format string, error string")


@query(f"SELECT {E_TAX} AS tax_id, period::BIGINT AS period FROM {_PANEL}")
def stream_table(spark, d):
    t = dv.Table("panel", dv.PerPeriod("person", [2020, 2021, 2022]), identifiers=["tax_id"])
    return dv.Pipeline(dv.Schema([_person(spark, d)], [t], SEED)).stream("panel")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 1::BIGINT AS loads FROM nation")
def source_cache(spark, d):
    """A frame that is asked for twice is loaded once, and read from the cache folder in a session that forgot it."""
    loads = []

    def load():
        loads.append(1)
        return _table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")

    folder, key = _folder(spark), uuid.uuid4().hex
    fetch.cached_frame(spark, key, load, folder)
    fetch._memo.pop((spark.sparkContext.applicationId, key))
    return fetch.cached_frame(spark, key, load, folder).withColumn("loads", F.lit(len(loads)).cast("bigint"))


def _nations(spark, d) -> list:
    """All 25 of them."""
    return _table(spark, d, "nation").orderBy("n_nationkey").collect()


@query("SELECT n_nationkey::BIGINT AS NATION, n_regionkey::BIGINT * 100 AS INCOME, n_name AS NAME FROM nation")
def pums_fetched(spark, d):
    """An answer behind a URL, an array of arrays of text, as typed columns."""
    payload = [["NATION", "INCOME", "NAME"], *([str(r.n_nationkey), str(r.n_regionkey * 100), r.n_name] for r in _nations(spark, d))]
    at = Path(tempfile.mkdtemp()) / "answer.json"  # fetched by the driver only
    at.write_text(json.dumps(payload))
    return pums.parse_pums(spark, json.loads(fetch.fetch_url(at.as_uri())), payload[0])


@query("SELECT i::BIGINT AS code, CASE WHEN (i BETWEEN 1 AND 56 AND i NOT IN (3, 7, 14, 43, 52)) OR i = 72 THEN lpad(i::VARCHAR, 2, '0') END AS fips FROM (SELECT unnest(range(100)) AS i)")
def pums_codes(spark, d):
    """What numbers are states' codes."""

    def code(i):
        return None if _refusal(lambda: pums.resolve_state(str(i)), ValueError) else pums.resolve_state(str(i))

    return spark.createDataFrame([(i, code(i)) for i in range(100)], "code bigint, fips string")


@query("SELECT 'KEY_' || n_nationkey AS name, n_name AS value FROM nation")
def pums_dotenv(spark, d):
    """A project's .env file: comments and lines without an assignment are nothing, of a name the first counts."""
    root = Path(tempfile.mkdtemp())
    nations = _nations(spark, d)
    lines = ["# KEY_0=no", "nothing", *(f"KEY_{r.n_nationkey} = {r.n_name}" for r in nations), *(f"KEY_{r.n_nationkey}=later" for r in nations)]
    (root / ".git").mkdir()
    (root / ".env").write_text("\n".join(lines))
    (root / "below").mkdir()
    return spark.createDataFrame(list(pums.read_dotenv(root / "below").items()), "name string, value string")


def _zipped(spark, name: str, members: dict[str, str]) -> str:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for member, text in members.items():
            z.writestr(member, text)
    return fetch.write_bytes(spark, f"{_folder(spark)}/{name}.zip", data.getvalue())


@query("SELECT 'US' AS country_code, lpad(n_nationkey::VARCHAR, 5, '0') AS postal_code, '\"' || n_name AS city, 'R' || n_regionkey AS state_abbr FROM nation")
def postal_archive(spark, d):
    """A zipped postal file; a quote in a name is a character like others."""
    rows = [["US", f"{r.n_nationkey:05d}", f'"{r.n_name}', "", f"R{r.n_regionkey}", "", "", "", "", "1.5", "-2.5", "4"] for r in _nations(spark, d)]
    path = _zipped(spark, "US", {"readme.txt": "x\ty", "US.txt": "\n".join("\t".join(r) for r in rows)})
    return people.postal_data(spark, path, _folder(spark)).select("country_code", "postal_code", "city", "state_abbr")


@query("SELECT n_name AS name, (1000 + n_nationkey)::BIGINT AS count, CASE WHEN n_regionkey = 0 THEN 0.0 ELSE n_regionkey * 10.0 END::DOUBLE AS pctwhite, (n_nationkey / 4.0)::DOUBLE AS pctapi FROM nation")
def surname_archive(spark, d):
    """Suppressed shares count as 0, and the row of all other names goes."""
    header = "name,rank,count,prop100k,cum_prop100k,pctwhite,pctblack,pctapi,pctaian,pct2prace,pcthispanic"
    rows = [f"{r.n_name},1,{1000 + r.n_nationkey},1,1,{r.n_regionkey * 10 if r.n_regionkey else '(S)'},0,{r.n_nationkey / 4},0,0,0" for r in _nations(spark, d)]
    path = _zipped(spark, "names", {"Names_2010Census.csv": "\n".join([header, *rows, "ALL OTHER NAMES,0,9,1,1,1,1,1,1,1,1"])})
    return people.surnames(spark, path, _folder(spark)).select("name", "count", "pctwhite", "pctapi")


@query("SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority AS name, count(*)::BIGINT AS count FROM orders GROUP BY ALL")
def names_archive(spark, d):
    """Zipped files of a year each, a name's counts of both sexes pooled."""
    orders = _table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority", (F.col("o_orderkey") % 2).alias("s")).count()
    texts: dict[str, list[str]] = {}
    for r in orders.collect():  # years by priorities by two
        texts.setdefault(f"yob{r.y}.txt", []).append(f"{r.o_orderpriority},{'FM'[r.s]},{r['count']}")
    path = _zipped(spark, "names", {k: "\n".join(v) for k, v in texts.items()})
    return people.yearly_names(spark, path, _folder(spark)).groupBy(F.col("year").cast("bigint").alias("year"), "name").agg(F.sum("count").alias("count"))


# ---- Rules and names -----------------------------------------------------------------------------------------------


@query(_pool_sql("'all'", {"all": {"Ann": 3.0, "Bob": 1.0, "Cid": 2.0}}))
def name_rule(spark, d):
    return people.Name("last_name", {"Ann": 3, "Bob": 1, "Cid": 2}).attach(_customers(spark, d), "v", "key", SEED, "rule").select("c_custkey", "v")


_COHORTS = {"1900|F": {"Mary": 400, "Ruth": 100}, "1900|M": {"John": 350, "Will": 200}, "2020|F": {"Emma": 260, "Olivia": 280}, "2020|M": {"Liam": 5, "Noah": 300}}


@query(_pool_sql("CASE WHEN c_nationkey < 12 THEN '1900' ELSE '2020' END || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END", _COHORTS))
def name_by_year_and_sex(spark, d):
    data = spark.createDataFrame([(int(k[:4]), n, k[5:], c) for k, pool in _COHORTS.items() for n, c in pool.items()], "year int, name string, sex string, count long")
    df = _customers(spark, d, "c_nationkey").withColumn("born", F.when(F.col("c_nationkey") < 12, 1900).otherwise(2020)).withColumn("sex", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M"))
    return people.SSAFirstName("born", "sex", source=data).attach(df, "v", "key", SEED, "rule").select("c_custkey", "v")


@query(f"SELECT c_custkey, {s_pick(s_unit(C, 'a'), ['1::BIGINT', '2::BIGINT', '3::BIGINT'])} AS a, {s_pick(s_unit(C, 'b'), [repr('x'), repr('y')])} AS b, 7::BIGINT AS c, 'z' AS d, TRUE AS e, 1.5::DOUBLE AS f FROM customer")
def rule_coerced(spark, d):
    """Lists and tuples are equal picks, plain values constants."""
    out = _customers(spark, d)
    for name, plain in {"a": [1, 2, 3], "b": ("x", "y"), "c": 7, "d": "z", "e": True, "f": 1.5}.items():
        out = coerce_rule(plain).attach(out, name, "key", SEED, name)
    return out.drop("key")


@query(f"SELECT c_custkey, {s_pick(s_unit(C, 'a'), ['1.0::DOUBLE', '2.5::DOUBLE'])} AS a, {s_pick(s_unit(C, 'b'), [repr('1'), repr('x')])} AS b, CASE WHEN c_nationkey = 3 THEN 1.0 ELSE {s_unit(C, 'c')} * 2.0::DOUBLE END::DOUBLE AS c FROM customer")
def rule_types(spark, d):
    """A rule's type is the widest of its values' and branches'."""
    out = _customers(spark, d, "c_nationkey").withColumn("n", F.col("c_nationkey"))
    rules = {"a": dv.Choice([1, 2.5]), "b": dv.Choice([1, "x"]), "c": dv.Conditional("n", {3: 1}, default=dv.Uniform(0, 2))}
    for name, rule in rules.items():
        out = rule.attach(out, name, "key", SEED, name)
    return out.select("c_custkey", "a", "b", "c")


class Checksum(dv.Rule):
    """A rule of a user's own."""

    def spark_type(self):
        return "bigint"

    def column(self, key, seed, salt, env):
        return F.length(key) * 10 + derive.integers(key, seed, salt, 0, 10)


@query(f"SELECT c_custkey, (length({C}) * 10 + {s_int(C, 'rule', 0, 10)})::BIGINT AS v FROM customer")
def custom_rule(spark, d):
    dv.check_rule(Checksum(), spark)
    return Checksum().attach(_customers(spark, d), "v", "key", SEED, "rule").select("c_custkey", "v")


class Unstable(dv.Rule):
    def column(self, key, seed, salt, env):
        return F.concat(key, F.lit(uuid.uuid4().hex))


@query("SELECT 'steady' AS rule, '' AS error UNION ALL SELECT 'unstable', 'RuleConformanceError'")
def check_rules(spark, d):
    keys = _customers(spark, d)
    tried = [(name, _refusal(lambda rule=rule: dv.check_rule(rule, spark, frame=keys), dv.RuleConformanceError)) for name, rule in (("steady", dv.Normal(0, 1)), ("unstable", Unstable()))]
    return spark.createDataFrame(tried, "rule string, error string")


# ---- Stages of a user's own ----------------------------------------------------------------------------------------


class Shout(dv.NoiseOp):
    def corrupt(self, value, key, seed, salt):
        return F.upper(value)


@query(f"SELECT c_custkey, CASE WHEN {s_hit('customer', 'c_custkey', 'c_name', 'shout')} < 0.4::DOUBLE THEN upper(c_name) ELSE c_name END AS v FROM customer")
def custom_noise(spark, d):
    from derivia.queries import _noised

    return _noised(spark, d, "customer", "c_custkey", "c_name", Shout(0.4))


class FromTable:
    """A generator that reads its rows instead of making them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def emit(self, table, ctx):
        key = F.concat(F.lit("person:"), F.col("c_custkey").cast("string"))
        return self.rows.select(key.alias(ENTITY_KEY), key.alias(ROW_KEY), F.col("c_custkey").alias(INDEX), F.lit(0).cast("bigint").alias(ORDINAL), F.col("c_acctbal").alias("balance"))


class Doubled:
    columns = ("balance",)

    def run(self, df, table, ctx):
        return df.withColumn("balance", F.col("balance") * 2)


class Tagged:
    def run(self, df, table, ctx):
        return df.withColumn("tag", F.concat(F.lit(f"{table.name}-"), F.col(ENTITY_KEY)))


@query("SELECT round(c_acctbal * 2, 4) AS balance, 't-person:' || c_custkey AS tag FROM customer")
def custom_stages(spark, d):
    """Generator, synthesizer and linker of a user's own, the noiser by its registered name."""

    class Nothing:
        def run(self, df, table, ctx):
            return df

    dv.register("noiser", "nothing", overwrite=True)(Nothing)
    schema = dv.Schema([dv.Entity("person", 1)], [dv.Table("t", "person", {"balance": 0.0})], SEED)
    try:
        return _rounded(_run(schema, "t", generator=FromTable(_table(spark, d, "customer")), synthesizer=Doubled(), linker=Tagged(), noiser="nothing"), "balance")
    finally:
        dv.unregister("noiser", "nothing")


@query("SELECT * FROM (VALUES ('generator', 0::BIGINT, 'rules'), ('synthesizer', 0, 'cart'), ('noiser', 0, 'noise'), ('linker', 0, 'deterministic'), ('structure', 0, 'declared'), ('structure', 1, 'empirical'), ('structure', 2, 'prior')) t(kind, place, name)")
def registry_names(spark, d):
    kinds = ("generator", "synthesizer", "noiser", "linker", "structure")
    return spark.createDataFrame([(k, i, n) for k in kinds for i, n in enumerate(dv.available(k))], "kind string, place bigint, name string")


class Random(dv.RuleGenerator):
    def emit(self, table, ctx):
        return super().emit(table, ctx).withColumn("education", F.lit(uuid.uuid4().hex))


class Short(dv.RuleGenerator):
    def emit(self, table, ctx):
        return super().emit(table, ctx).filter(F.col(INDEX) > 3)


class Drops:
    columns = ("birth_year",)

    def run(self, df, table, ctx):
        return df.filter(F.col(INDEX) > 3)


class Touches(Drops):
    def run(self, df, table, ctx):
        return df.withColumn("education", F.lit("x"))


@query("SELECT * FROM (VALUES ('rules', ''), ('random', 'GeneratorConformanceError'), ('short', 'GeneratorConformanceError'), ('unsplit', 'ValueError'), ('cart', ''), ('drops', 'SynthesizerConformanceError'), ('touches', 'SynthesizerConformanceError')) t(stage, error)")
def check_stages(spark, d):
    """What the checks say of stages that keep their promises and of such as break one."""
    schema = _roster(spark, d)
    kinds = (dv.GeneratorConformanceError, dv.SynthesizerConformanceError, ValueError)
    generators = {"rules": (dv.RuleGenerator(), 13), "random": (Random(), 13), "short": (Short(), 13), "unsplit": (dv.RuleGenerator(), 10**9)}
    one = dv.Schema([dv.Entity("person", 1, {"education": EDU})], [dv.Table("roster", "person", carry="*")], SEED)
    found = [(name, _refusal(lambda g=g, n=n: dv.check_generator(g, one if n > 13 else schema, spark=spark, split_rows=n), *kinds)) for name, (g, n) in generators.items()]
    cart = CARTSynthesizer(["birth_year"], structure=_table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("birth_year")))
    found += [(name, _refusal(lambda s=s: dv.check_synthesizer(s, schema, spark=spark), *kinds)) for name, s in (("cart", cart), ("drops", Drops()), ("touches", Touches()))]
    return spark.createDataFrame(found, "stage string, error string")


# ---- Populations, linkage and reports ------------------------------------------------------------------------------


@query(f"SELECT unnest([7, 200, 1000000])::BIGINT AS partition_rows, TRUE AS bounded, count(*)::BIGINT AS n, round(sum({s_unit(P, 'table' + Z + 't' + Z + 'u')}), 4) AS total FROM {N}")
def partition_sizes(spark, d):
    """Rows that a partition aims at bound the partitions and change no value."""
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"u": dv.Uniform(0, 1)})], SEED)
    out = None
    for rows in (7, 200, 1_000_000):
        t = dv.Pipeline(schema, partition_rows=rows).run()["t"]
        each = t.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("u").alias("total"))
        one = each.agg(F.lit(rows).cast("bigint").alias("partition_rows"), (F.max("n") <= rows).alias("bounded"), F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
        out = one if out is None else out.union(one)
    return out


_HALF = f"(SELECT * FROM {_PANEL} WHERE {s_cov('panel', 0.5).replace(P, 'e')})"


@query(f"SELECT 'entities_total' AS fact, (SELECT count(*) FROM {N})::BIGINT AS value UNION ALL SELECT 'entities_covered', count(DISTINCT e) FROM {_HALF} UNION ALL SELECT 'rows', count(*) FROM {_HALF}")
def stage_counts(spark, d):
    t = dv.Table("panel", dv.PerPeriod("person", [2020, 2021, 2022]), coverage=0.5)
    facts = dv.Pipeline(dv.Schema([_person(spark, d)], [t], SEED)).run().metadata["panel"]["generate"]
    return spark.createDataFrame([(k, facts[k]) for k in ("entities_total", "entities_covered", "rows")], "fact string, value bigint")


@query(f"SELECT education, count(DISTINCT {E_TAX})::BIGINT AS people, count(*)::BIGINT AS n FROM (SELECT *, {s_edu(key='e')} AS education FROM {_PANEL}) GROUP BY education")
def distinct_entities(spark, d):
    t = dv.Table("panel", dv.PerPeriod("person", [2020, 2021, 2022]), carry=["education"], identifiers=["tax_id"])
    return _run(dv.Schema([_person(spark, d)], [t], SEED), "panel").groupBy("education").agg(F.countDistinct("tax_id").alias("people"), F.count("*").alias("n"))


@query(f"SELECT (row_number() OVER (ORDER BY i, p_no) - 1)::BIGINT AS place, {E_TAX} AS tax_id, period::BIGINT AS period FROM (SELECT i, {P} AS e, p AS period, p_no FROM {N}, (VALUES (2022, 0), (2020, 1), (2021, 2)) t(p, p_no))")
def ordered_run(spark, d):
    """By entity, then period as declared; the place is read from the partitions' order."""
    t = dv.Table("panel", dv.PerPeriod("person", [2022, 2020, 2021]), identifiers=["tax_id"])
    rows = dv.Pipeline(dv.Schema([_person(spark, d)], [t], SEED)).run(ordered=True)["panel"]
    at = rows.withColumn("at", F.monotonically_increasing_id())
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return at.join(starts, part == F.col("part")).select((F.col("start") + inside).alias("place"), "tax_id", "period")


def _pair(spark, d):
    tables = [dv.Table("k12", "person", carry=["education"], identifiers=["tax_id"], coverage=0.7), dv.Table("dmv", "person", carry=["birth_year"], identifiers=["tax_id"], coverage=0.6)]
    t = dv.Pipeline(dv.Schema([_person(spark, d)], tables, SEED)).run().tables
    return t["k12"], t["dmv"]


_K12, _DMV = s_cov("k12", 0.7), s_cov("dmv", 0.6)


@query(f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education, CASE WHEN {_DMV} THEN {S_BIRTH} END AS birth_year FROM {N} WHERE {_K12}")
def link_join_left(spark, d):
    a, b = _pair(spark, d)
    return a.join(b, "tax_id", "left")


@query(f"SELECT {S_TAX} AS tax_id, CASE WHEN {_K12} THEN {s_edu()} END AS education, {S_BIRTH} AS birth_year FROM {N} WHERE {_DMV}")
def link_join_right(spark, d):
    a, b = _pair(spark, d)
    return a.join(b, "tax_id", "right")


@query(f"SELECT period::BIGINT AS period, {s_edu(key='e')} AS in_roster, {s_edu(key='e')} AS in_panel FROM {_PANEL}")
def carry_joined(spark, d):
    """A carried attribute, side by side from two tables of different grains."""
    panel = dv.Table("panel", dv.PerPeriod("person", [2020, 2021, 2022]), carry=["education"], identifiers=["tax_id"])
    t = dv.Pipeline(_roster(spark, d, tables=[panel])).run().tables
    return t["panel"].withColumnRenamed("education", "in_panel").join(t["roster"].select("tax_id", F.col("education").alias("in_roster")), "tax_id").select("period", "in_roster", "in_panel")


@query(f"SELECT education, count(*)::BIGINT AS n, round(avg(wage), 3) AS mean_wage, round(avg(CASE WHEN lost THEN 1.0 ELSE 0.0 END), 6) AS share_lost FROM (SELECT education, lost, CASE WHEN NOT lost THEN {s_wage('wages', 'r', 9)} END AS wage FROM (SELECT e, r, period, {s_edu(key='e')} AS education, {s_unit('r', 'noise' + Z + 'wages' + Z + 'wage' + Z + 'missing')} < 0.1::DOUBLE AS lost, {S_BIRTH.replace(P, 'e')} AS birth_year FROM {_PANEL}) WHERE period - birth_year >= 18) GROUP BY education")
def example_adults(spark, d):
    """Means and losses by group of those who are 18 or older in the period."""
    t = dv.Table("wages", dv.PerPeriod("person", [2020, 2021, 2022]), {"wage": _WAGE}, carry=["education", "birth_year"])
    wages = _run(dv.Schema([_person(spark, d)], [t], SEED), "wages", noiser=Noise({"wages": {"wage": [Missing(0.1)]}}))
    adults = wages.filter(F.col("period") - F.col("birth_year") >= 18)
    return adults.groupBy("education").agg(F.count("*").alias("n"), F.round(F.avg("wage"), 3).alias("mean_wage"), F.round(F.avg(F.col("wage").isNull().cast("double")), 6).alias("share_lost"))


@query("""SELECT * FROM (VALUES ('person.count', (SELECT count(*) FROM customer)::VARCHAR, 'user-provided', ''), ('t.coverage', '0.5', 'cited', 'a survey'), ('t.noise.v.missing.rate', (1 / (SELECT count(*) FROM region)::DOUBLE)::VARCHAR, 'modeled', 'a guess')) t(path, value, origin, note)""")
def prov_of_run(spark, d):
    rate = 1 / _table(spark, d, "region").count()
    schema = dv.Schema([_customer_entity(spark, d)], [dv.Table("t", "person", {"v": 1}, coverage=dv.cited(0.5, "a survey"))], SEED)
    return dv.Pipeline(schema, noiser=Noise({"t": {"v": [Missing(dv.modeled(rate, "a guess"))]}})).run().provenance.to_frame(spark)


# ---- Noise ---------------------------------------------------------------------------------------------------------


@query(s_typo("part", "p_partkey", "p_size", 0.5).replace("p_size AS t", "p_size::VARCHAR AS t").replace("length(p_size)", "length(p_size::VARCHAR)"))
def noise_makes_text(spark, d):
    """Typing errors make a number's column text, in the hit rows and in the others."""
    from derivia.queries import _noised

    return _noised(spark, d, "part", "p_partkey", "p_size", Typo(0.5))


@query(f"SELECT c_custkey, CASE WHEN {s_hit('customer', 'c_custkey', 'c_nationkey', 'missing')} < CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END THEN NULL ELSE c_nationkey END AS v FROM customer")
def noise_rate_on_any_name(spark, d):
    """A row's rate from columns whose names are those of plan operators; a missing integer leaves an integer column."""
    from derivia.operators.noise import corrupted

    df = _customers(spark, d, "c_nationkey", "c_mktsegment").withColumn("Window_open", F.col("c_mktsegment") == "BUILDING").withColumn("Aggregate_id", F.lit(0.5))
    out, _ = corrupted(df, "c_nationkey", Missing(lambda row: F.when(row["Window_open"], row["Aggregate_id"]).otherwise(0.0)), SEED, f"noise{Z}customer{Z}c_nationkey{Z}missing", "key")
    return out.select("c_custkey", F.col("c_nationkey").alias("v"))


@query("SELECT * FROM (VALUES ('row', ''), ('average', 'ValueError'), ('window', 'ValueError'), ('generator', 'ValueError'), ('number', 'ValueError'), ('above', 'ValueError')) t(rate, error)")
def noise_rate_refusals(spark, d):
    """Rates must be functions of a row, or numbers from 0 to 1."""
    df = _customers(spark, d, "c_acctbal").withColumn(ROW_KEY, F.col("key"))
    rates = {
        "row": lambda row: row["c_acctbal"] * 0, "average": lambda row: F.avg(row["c_acctbal"]), "window": lambda row: F.rank().over(Window.orderBy(row["c_acctbal"])) / 10**9,
        "generator": lambda row: F.explode(F.array(row["c_acctbal"])), "number": lambda row: 0.5,
    }
    found = [(k, _refusal(lambda rate=rate: Missing(rate).probability(df), ValueError)) for k, rate in rates.items()]
    return spark.createDataFrame([*found, ("above", _refusal(lambda: Missing(1.5), ValueError))], "rate string, error string")


@query(f"""SELECT c_custkey, {s_id(C, 'customer' + Z + 'tax_id', 9)} AS tax_id, round({s_unit(C, 'table' + Z + 't' + Z + 'score')} * 10.0::DOUBLE, 9) AS score,
CASE WHEN {s_unit(C, 'noise' + Z + 't' + Z + 'c_name' + Z + 'missing')} < 0.2::DOUBLE THEN NULL ELSE c_name END AS c_name FROM customer""")
def stream_stages(spark, d):
    """The row-wise stages over a stream of files, once each."""
    folder = _folder(spark)
    schema = "c_custkey bigint, c_name string"

    def prepare(df):
        df = df.withColumn("key", streaming.row_key("customer", "c_custkey"))
        df = streaming.with_columns(df, "key", {"score": dv.Uniform(0, 10)}, SEED, "t")
        df = streaming.with_noise(df, "key", {"c_name": [Missing(0.2)]}, SEED, "t")
        return streaming.with_ids(df, F.col("key"), {"tax_id": (f"customer{Z}tax_id", 9)}, SEED)

    _table(spark, d, "customer").select("c_custkey", "c_name").write.parquet(f"{folder}/in")
    for _ in range(2):  # the second time there is nothing new
        streaming.run_available(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", prepare)
    return _rounded(spark.read.parquet(f"{folder}/out"), "score", 9).select("c_custkey", "tax_id", "score", "c_name")


# ---- Structure and synthesis ---------------------------------------------------------------------------------------


def s_slot(column: str, n: str, table: str = "t") -> str:
    """The donor that a first column's row draws, of n."""
    return f"({s_u64(P, f'synth{Z}{table}{Z}{column}')} % ({n})::UBIGINT)::BIGINT"


@query(f"""WITH own AS (SELECT i, round({s_unit(P, 'table' + Z + 't' + Z + 'v')} * 10.0::DOUBLE, 9) AS v FROM {N})
SELECT 't' AS "table", d.v FROM (SELECT {s_slot('v', 'least(600, (SELECT count(*) FROM customer))')} AS slot FROM {N}) JOIN own d ON d.i = slot
UNION ALL SELECT 'other', round({s_unit(P, 'table' + Z + 'other' + Z + 'v')} * 10.0::DOUBLE, 9) FROM {N}""")
def declared_first_rows(spark, d):
    """Learned from the declared rows themselves, the first 600 of them; another table is out of the synthesizer's scope."""
    tables = [dv.Table(t, "person", {"v": dv.Uniform(0, 10)}) for t in ("t", "other")]
    r = dv.Pipeline(dv.Schema([_person(spark, d)], tables, SEED), synthesizer=CARTSynthesizer(["v"], tables=["t"], fit_cap=600)).run()
    out = [_rounded(r[t], "v", 9).select(F.lit(t).alias("table"), "v") for t in ("t", "other")]
    return out[0].union(out[1])


_DRAWN_ORDERS = f"""WITH kept AS (SELECT o_orderkey, o_totalprice FROM orders WHERE {s_unit("('{\"o_orderkey\":' || o_orderkey || '}|1')", f'fitsample{Z}t')} < 1000.0::DOUBLE / (SELECT count(*) FROM orders) ORDER BY o_orderkey LIMIT 1000),
donors AS (SELECT o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM kept)"""


@query(f"{_DRAWN_ORDERS} SELECT (SELECT count(*) FROM kept)::BIGINT AS fit_rows, (SELECT count(*) FROM orders) > 1000 AS sampled, round(d.price, 4) AS price FROM {N} JOIN donors d ON d.pos = {s_slot('o_totalprice', '(SELECT max(n) FROM donors)')}")
def cart_sampled_fit(spark, d):
    """More donors than the cap: those of a draw on their order key, and values of these only."""
    donors = _table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"o_totalprice": 0.0})], SEED)
    result = dv.Pipeline(schema, synthesizer=CARTSynthesizer(["o_totalprice"], structure=dv.Empirical(donors, order_by=["o_orderkey"]), fit_cap=1000)).run()
    facts = result.metadata["t"]["synthesize"]
    return result["t"].select(F.lit(facts["fit_rows"]).cast("bigint").alias("fit_rows"), F.lit(facts["sampled"]).alias("sampled"), F.round("o_totalprice", 4).alias("price"))


@query(f"""WITH donors AS (SELECT p_size::BIGINT AS size, p_brand AS brand, p_retailprice AS price, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part)
SELECT a.size, b.brand, round(c.price, 4) AS price FROM {N} JOIN donors a ON a.pos = {s_slot('size', '(SELECT max(n) FROM donors)')} JOIN donors b ON b.pos = {s_slot('brand', '(SELECT max(n) FROM donors)')} JOIN donors c ON c.pos = {s_slot('price', '(SELECT max(n) FROM donors)')}""")
def cart_chained_types(spark, d):
    """Three synthesizers in a row, each of one column of its own type: whole number, text, number."""
    donors = _table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    structure = dv.Empirical(donors, order_by=["p_partkey"])
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"size": 0, "brand": "", "price": 0.0})], SEED)
    chain = ChainedSynthesizer([CARTSynthesizer([c], structure=structure, label=c) for c in ("size", "brand", "price")])
    return _rounded(_run(schema, "t", synthesizer=chain), "price")


_STUMP = f"""WITH donors AS (SELECT p_size AS x, p_retailprice AS y, p_partkey FROM part),
m AS (SELECT avg(y) AS mean, count(*) AS n FROM donors),
steps AS (SELECT x, sum(count(*)) OVER w AS n1, sum(sum(y - (SELECT mean FROM m))) OVER w AS s1, lead(x) OVER (ORDER BY x) AS nxt FROM donors GROUP BY x WINDOW w AS (ORDER BY x)),
cut AS (SELECT x + (nxt - x) / 2.0 AS t FROM steps, m WHERE nxt IS NOT NULL AND n1 >= 5 AND m.n - n1 >= 5 ORDER BY s1 * s1 / n1 + s1 * s1 / (m.n - n1) DESC, x LIMIT 1),
leaves AS (SELECT y, x <= (SELECT t FROM cut) AS low, row_number() OVER (PARTITION BY x <= (SELECT t FROM cut) ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY x <= (SELECT t FROM cut)) AS size FROM donors),
rows_ AS (SELECT {s_int(P, f'entity{Z}person{Z}size', 1, 51)} AS size, {s_unit(P, f'synth{Z}t{Z}price')} AS u FROM {N})
SELECT r.size, round(l.y, 4) AS price FROM rows_ r JOIN leaves l ON l.low = (r.size <= (SELECT t FROM cut)) AND l.pos = least(floor(r.u * l.size), l.size - 1)"""


@query(_STUMP)
def cart_numeric_split(spark, d):
    """A tree of one split: the threshold of least squared error, and donors of the row's side."""
    donors = _table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price"))
    e = _customer_entity(spark, d, attributes={"size": dv.Integer(1, 51)})
    schema = dv.Schema([e], [dv.Table("t", "person", {"price": 0.0}, carry=["size"])], SEED)
    return _rounded(_run(schema, "t", synthesizer=CARTSynthesizer(["price"], predictors=["size"], structure=dv.Empirical(donors, order_by=["p_partkey"]), max_depth=1)), "price")


_JOINT = {("HS", "yes"): 0.30, ("HS", "no"): 0.30, ("College", "yes"): 0.38, ("College", "no"): 0.02}


@query(f"""SELECT split_part(c, '|', 1) AS education, count(*)::BIGINT AS n FROM (SELECT {s_pick(s_unit('k', f'prior{Z}education{Z}employed'), ["'HS|yes'", "'HS|no'", "'College|yes'", "'College|no'"], list(_JOINT.values()))} AS c FROM {s_prior(5000, 't')}) GROUP BY 1""")
def prior_implied_marginal(spark, d):
    """A joint's column follows the joint, which implies its marginal."""
    from derivia.queries import _training

    return _training(spark, dv.Prior({"education": {"HS": 0.6, "College": 0.4}}, {("education", "employed"): _JOINT}, rows=5000)).groupBy("education").agg(F.count("*").alias("n"))


_SHIFTS = (0.0, 5e-7, 2e-6, 1e-3, 0.1)


@query(f"SELECT shift, CASE WHEN shift > 1e-6 THEN 'ValueError' ELSE '' END AS error FROM (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _SHIFTS)}]) AS shift)")
def prior_consistency(spark, d):
    """A joint that gives a column another marginal than is stated, by more than a millionth."""
    joint = lambda s: {("a", "x"): 0.3 + s, ("a", "y"): 0.2, ("b", "x"): 0.25 - s, ("b", "y"): 0.25}
    tried = [(s, _refusal(lambda s=s: dv.Prior({"p": {"a": 0.5, "b": 0.5}}, {("p", "q"): joint(s)}), ValueError)) for s in _SHIFTS]
    return spark.createDataFrame(tried, "shift double, error string")


@query("SELECT * FROM (VALUES ('none', 'Declared'), ('declared', 'Declared'), ('empirical', 'StructureConfigError'), ('unknown', 'KeyError'), ('marginals', 'Prior'), ('flat', 'TypeError'), ('weights', 'TypeError'), ('frame', 'Empirical'), ('number', 'TypeError')) t(given, result)")
def structure_names(spark, d):
    """What a structure may be given as."""
    from derivia.operators.structure import coerce_structure

    given = {"none": None, "declared": "declared", "empirical": "empirical", "unknown": "nothing", "marginals": {"a": {1: 1.0}}, "flat": {"a": 1.0}, "weights": {"a": {1: "x"}}, "frame": _table(spark, d, "region"), "number": 3}
    found = []
    for name, value in given.items():
        error = _refusal(lambda value=value: coerce_structure(value), TypeError, KeyError)
        found.append((name, error or type(coerce_structure(value)).__name__))
    return spark.createDataFrame(found, "given string, result string")


@query("SELECT * FROM (VALUES ('fine', ''), ('donors lack it', 'KeyError'), ('table lacks it', 'KeyError'), ('no column', 'ValueError'), ('text as number', 'ValueError')) t(asked, error)")
def synthesis_refusals(spark, d):
    """Columns that the donors or the table lack, and numbers that are none."""
    donors = _table(spark, d, "part").select("p_brand", F.col("p_size").cast("bigint").alias("v"), F.lit(1).alias("other"))
    schema = dv.Schema([dv.Entity("person", 5)], [dv.Table("t", "person", {"v": 0, "p_brand": ""})], SEED)
    run = lambda columns, **more: _run(schema, "t", synthesizer=CARTSynthesizer(columns, structure=donors, **more)).collect()
    asked = {"fine": lambda: run(["v"]), "donors lack it": lambda: run(["w"]), "table lacks it": lambda: run(["other"]), "no column": lambda: run([]), "text as number": lambda: run(["v", "p_brand"], numeric=["p_brand"])}
    return spark.createDataFrame([(k, _refusal(f, KeyError, ValueError)) for k, f in asked.items()], "asked string, error string")


@query(f"SELECT 't' AS \"table\", 0::BIGINT AS lost, count(*)::BIGINT AS n FROM {N}")
def donor_diagnostics(spark, d):
    """No row of a table that has been synthesized met a leaf without donors."""
    cart = CARTSynthesizer(["v"], predictors=["education"], structure=_table(spark, d, "customer").select(F.col("c_mktsegment").alias("education"), F.col("c_acctbal").alias("v")), min_samples_leaf=1)
    n = _run(dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"v": 0.0}, carry=["education"])], SEED), "t", synthesizer=cart).filter("v is not null").count()
    return spark.createDataFrame([(t, sum(v.values()), n) for t, v in cart.donor_diagnostics().items()], "table string, lost bigint, n bigint")


# ---- Modes ---------------------------------------------------------------------------------------------------------

_EPSILONS = (0.001, 0.01, 0.3, 1.0, 2.0, 5.0, 9.0)


@query(f"""WITH e AS (SELECT epsilon, least(greatest(epsilon, 0.01::DOUBLE), 5.0::DOUBLE) AS x FROM (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _EPSILONS)}]) AS epsilon))
SELECT epsilon, CASE WHEN x < 5 THEN greatest(1, round(4 * x)) END::BIGINT AS max_depth, greatest(5, round(100 / x))::BIGINT AS leaf, greatest(1000, round(200000 * x / 5))::BIGINT AS fit_cap FROM e""")
def mode_epsilon(spark, d):
    knobs = [(e, cart_knobs(e)) for e in _EPSILONS]
    return spark.createDataFrame([(e, k["max_depth"], k["min_samples_leaf"].value, k["fit_cap"]) for e, k in knobs], "epsilon double, max_depth bigint, leaf bigint, fit_cap bigint")


@query(f"WITH donors AS (SELECT c_acctbal AS balance, row_number() OVER (ORDER BY c_acctbal) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT round(d.balance, 4) AS balance FROM {N} JOIN donors d ON d.pos = {s_slot('balance', '(SELECT max(n) FROM donors)')}")
def mode_real_marginal(spark, d):
    """One column of real rows: each value is a donor's."""
    mode = dv.Mode.real_data(_table(spark, d, "customer").select(F.col("c_acctbal").alias("balance")), epsilon=5, spark=spark)
    e = mode.entity("person", count=_table(spark, d, "customer").count(), attributes={"balance": mode.attribute("balance")})
    return _rounded(mode.schema(entities=[e], tables=[mode.table("t", grain="person", carry="*")], seed=SEED).run()["t"], "balance")


def s_lost(table: str, column: str, rate: float, value: str) -> str:
    return f"CASE WHEN {s_unit(P, f'noise{Z}{table}{Z}{column}{Z}missing')} < {rate}::DOUBLE THEN NULL ELSE {value} END"


_GRADE = s_pick(s_unit(P, f"entity{Z}person{Z}grade"), ["'A'", "'B'"])


@query(f"SELECT 'a' AS \"table\", {s_lost('a', 'grade', 0.3, _GRADE)} AS grade FROM {N} UNION ALL SELECT 'b', {s_lost('b', 'grade', 0.3, _GRADE)} FROM {N}")
def mode_noise_everywhere(spark, d):
    """An attribute's noise is in every table that carries it."""
    mode = dv.Mode.metadata(spark)
    e = mode.entity("person", count=_table(spark, d, "customer").count(), attributes={"grade": mode.attribute("grade", values=["A", "B"], missing_rate=0.3)})
    t = mode.schema(entities=[e], tables=[mode.table(x, grain="person", carry="*") for x in "ab"], seed=SEED).run().tables
    return t["a"].select(F.lit("a").alias("table"), "grade").union(t["b"].select(F.lit("b"), "grade"))


class Local(dv.Mode.scope("NY").__class__):
    """The scope mode with rows that are here instead of fetched ones."""

    def __init__(self, rows: DataFrame):
        super().__init__(rows.sparkSession, 5.0, "NY")
        self.rows = rows

    @property
    def donors(self) -> DataFrame:
        return self.rows.select(*[F.col(v).alias(n) for n, v in self._variables.items()])


@query(f"WITH donors AS (SELECT c_nationkey::BIGINT AS age, row_number() OVER (ORDER BY c_nationkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT d.age FROM {N} JOIN donors d ON d.pos = {s_slot('age', '(SELECT max(n) FROM donors)')}")
def mode_scope_marginal(spark, d):
    """A variable of the microdata under an attribute's name."""
    mode = Local(_table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("AGEP")))
    e = mode.entity("person", count=_table(spark, d, "customer").count(), attributes={"age": mode.attribute("age", variable="AGEP")})
    return mode.schema(entities=[e], tables=[mode.table("t", grain="person", carry="*")], seed=SEED).run()["t"]


@query("SELECT * FROM (VALUES ('fine', ''), ('no such option', 'ValueError'), ('no mean', 'ValueError'), ('nothing', 'ValueError'), ('epsilon', 'ValueError'), ('unplaced noise', 'ValueError'), ('unplaced column', 'ValueError'), ('renamed', 'ValueError'), ('no variable', 'ValueError')) t(asked, error)")
def mode_refusals(spark, d):
    rows = _table(spark, d, "region").select("r_name")

    def schema(mode, bound, name, **options):
        e = mode.entity("person", count=3, attributes={bound: mode.attribute(name, **options)})
        return mode.schema(entities=[e], tables=[mode.table("t", grain="person", carry="*")])

    def unplaced(mode, **options):
        mode.attribute("lost", **options)
        return schema(mode, "r_name", "r_name", **({"values": [1]} if "values" in options else {}))

    meta, real = lambda: dv.Mode.metadata(spark), lambda **o: dv.Mode.real_data(rows, spark=spark, **o)
    asked = {
        "fine": lambda: schema(meta(), "a", "a", min=0, max=1, typo_rate=0.1), "no such option": lambda: schema(meta(), "a", "a", values=[1], missing_rat=0.1),
        "no mean": lambda: schema(meta(), "a", "a", distribution="normal", sd=1), "nothing": lambda: schema(meta(), "a", "a"), "epsilon": lambda: real(epsilon=0),
        "unplaced noise": lambda: unplaced(meta(), values=[1], ocr_rate=0.1), "unplaced column": lambda: unplaced(real()), "renamed": lambda: schema(real(), "other", "r_name"),
        "no variable": lambda: dv.Mode.scope("NY", spark=spark).attribute("a"),
    }
    return spark.createDataFrame([(k, _refusal(f, ValueError)) for k, f in asked.items()], "asked string, error string")


# ---- Checks of a schema --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('fine', ''), ('no entity', 'SchemaError'), ('no table', 'SchemaError'), ('entity twice', 'SchemaError'), ('table twice', 'SchemaError'), ('reserved', 'SchemaError'), ('cycle', 'SchemaError'), ('unknown entity', 'SchemaError'), ('unknown attribute', 'SchemaError'), ('unknown identifier', 'SchemaError'), ('carried and made', 'SchemaError'), ('identifier and column', 'SchemaError'), ('grain and column', 'SchemaError')) t(declared, error)")
def schema_refusals(spark, d):
    person = lambda **a: dv.Entity("person", 3, {"a": 1, **a}, ["tax_id"])
    made = lambda entities, tables: lambda: dv.Pipeline(dv.Schema(entities, tables), spark=spark)
    table = lambda *a, **k: [dv.Table("t", *(a or ("person",)), **k)]
    cases = {
        "fine": made([person()], table(carry="*", identifiers=["tax_id"])), "no entity": made([], table()), "no table": made([person()], []), "entity twice": made([person(), person()], table()),
        "table twice": made([person()], table() + table()), "reserved": made([person(_dv_x=1)], table()), "cycle": made([person(b=dv.Sequential("c", lambda x: x), c=dv.Sequential("b", lambda x: x))], table()),
        "unknown entity": made([person()], table("firm")), "unknown attribute": made([person()], table(carry=["z"])), "unknown identifier": made([person()], table(identifiers=["z"])),
        "carried and made": made([person()], table(columns={"a": 2}, carry=["a"])), "identifier and column": made([person()], table(columns={"tax_id": 2}, identifiers=["tax_id"])),
        "grain and column": made([person()], table(dv.PerPeriod("person", [1]), columns={"period": 2})),
    }
    return spark.createDataFrame([(k, _refusal(f, ValueError)) for k, f in cases.items()], "declared string, error string")


@query("SELECT count AS count, digits, CASE WHEN count::DOUBLE * count >= 2 * 10::DOUBLE ** digits THEN 'SchemaError' ELSE '' END AS error FROM (SELECT 10::BIGINT ** unnest(range(0, 9)) AS count) , (SELECT unnest(range(1, 19))::BIGINT AS digits)".replace("10::BIGINT ** unnest(range(0, 9))", "unnest(list_transform(range(0, 9), lambda k: (10 ** k)::BIGINT))"))
def identifier_widths(spark, d):
    """Too few digits for a population, by the birthday bound."""
    def made(count, digits):
        return lambda: dv.Pipeline(dv.Schema([dv.Entity("p", count, {}, [dv.Identifier("t", digits=digits)])], [dv.Table("t", "p")]), spark=spark)

    tried = [(10**k, n, _refusal(made(10**k, n), ValueError)) for k in range(9) for n in range(1, MAX_DIGITS + 1)]
    return spark.createDataFrame(tried, "count bigint, digits bigint, error string")


@query("""SELECT * FROM (VALUES ('period twice', 'ValueError'), ('no period', 'ValueError'), ('presence 0', 'ValueError'), ('presence 1', ''), ('events 2 to 2', 'ValueError'), ('events 0 to 2', ''), ('coverage 1.5', 'ValueError'), ('count 0', 'ValueError'), ('tag twice', 'ValueError'), ('no tag', 'ValueError')) t(declared, error)""")
def grain_refusals(spark, d):
    cases = {
        "period twice": lambda: dv.PerPeriod("p", [1, 1]), "no period": lambda: dv.PerPeriod("p", []), "presence 0": lambda: dv.PerPeriod("p", [1], presence=0), "presence 1": lambda: dv.PerPeriod("p", [1]),
        "events 2 to 2": lambda: dv.PerEvent("p", 2, 2), "events 0 to 2": lambda: dv.PerEvent("p", 0, 2), "coverage 1.5": lambda: dv.Table("t", "p", coverage=1.5), "count 0": lambda: dv.Entity("p", 0),
        "tag twice": lambda: dv.Entity("p", 1, {}, ["a", "a"]), "no tag": lambda: dv.Identifier(""),
    }
    return spark.createDataFrame([(k, _refusal(f, ValueError)) for k, f in cases.items()], "declared string, error string")


# ---- Fidelity ------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT p_retailprice AS v, count(*) FILTER (p_partkey % 2 = 0) AS x, count(*) FILTER (p_partkey % 2 = 1) AS y FROM part GROUP BY 1),
c AS (SELECT sum(x) OVER (ORDER BY v) AS f, sum(y) OVER (ORDER BY v) AS g FROM v), k AS (SELECT max(abs(f - g))::BIGINT AS k, (SELECT sum(x) FROM v)::BIGINT AS n, (SELECT sum(y) FROM v)::BIGINT AS m FROM c)
SELECT n, m, round(least(1.0, 2 * (SELECT sum((-1) ** (j - 1) * CASE WHEN j * k <= n THEN exp(2 * lgamma(n + 1.0) - lgamma(n - j * k + 1.0) - lgamma(n + j * k + 1.0)) ELSE 0 END) FROM (SELECT unnest(range(1, 400)) AS j))), 6) AS p FROM k""")
def fid_ks_pvalue(spark, d):
    """Of two samples of one size the exact p-value has a closed form: reflected lattice paths."""
    part = _table(spark, d, "part")
    s, n, m = fidelity.ks(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1"), "p_retailprice").first()
    return spark.createDataFrame([(n, m, round(fidelity.ks_pvalue(s, n, m), 6))], "n bigint, m bigint, p double")


@query("""WITH a AS (SELECT l_linestatus v, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_linestatus v, count(*) m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
d AS (SELECT sum(abs(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM a) - coalesce(m, 0)::DOUBLE / (SELECT sum(m) FROM b))) / 2 AS delta FROM a FULL JOIN b USING (v))
SELECT 'l_linestatus' AS column_name, round(delta, 9) AS value, t AS threshold, delta <= t AS passed FROM d, (SELECT unnest([0.0::DOUBLE, 0.001::DOUBLE, 0.01::DOUBLE, 0.5::DOUBLE]) AS t)""")
def fid_verdicts(spark, d):
    t = _table(spark, d, "lineitem")
    out = None
    for limit in (0.0, 0.001, 0.01, 0.5):
        stats = fidelity.fidelity_report(t.filter("l_returnflag = 'A'"), t.filter("l_returnflag = 'R'"), ["l_linestatus"], thresholds={"category_share_delta": limit}).column_stats
        one = stats.select(F.col("column").alias("column_name"), F.round("value", 9).alias("value"), F.lit(limit).alias("threshold"), "passed")
        out = one if out is None else out.union(one)
    return out


@query("SELECT * FROM (VALUES ('fine', ''), ('no column', 'ValueError'), ('a column that is not there', 'KeyError'), ('no synthesizer', 'TypeError')) t(asked, error)")
def fid_refusals(spark, d):
    t = _table(spark, d, "region")
    asked = {"fine": (["r_name"], {}), "no column": ([], {}), "a column that is not there": (["r_name", "z"], {}), "no synthesizer": (["r_name"], {"synthesizer": 3})}
    found = [(k, _refusal(lambda c=c, o=o: fidelity.fidelity_report(t, t, c, **o), ValueError, KeyError, TypeError)) for k, (c, o) in asked.items()]
    return spark.createDataFrame(found, "asked string, error string")
