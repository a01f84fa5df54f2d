"""Queries for each operator over the driver's tables, and the SQL that another engine must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import derivia as dv
from derivia.functions import derive
from derivia.functions.rules import PoolChoice
from derivia.operators import fidelity
from derivia.operators.noise import OCR, Missing, Noise, Typo
from derivia.operators.synthesize import CARTSynthesizer
from derivia.plans.schema import ENTITY_KEY
from derivia.sources import people, pums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", *columns, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"))


# The kernel in SQL: what DuckDB must compute.
def s_hash(key: str, salt: str, seed: int | str = SEED) -> str:
    return f"md5('{derive.hash_key(seed, salt)}' || {key})"


def s_u64(key: str, salt: str, seed: int | str = SEED) -> str:
    return f"('0x' || substr({s_hash(key, salt, seed)}, 1, 16))::UBIGINT"


def s_unit(key: str, salt: str, seed: int | str = SEED) -> str:
    return f"(('0x' || substr({s_hash(key, salt, seed)}, 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def s_int(key: str, salt: str, low: int, high: int, seed: int | str = SEED) -> str:
    return f"(({s_u64(key, salt, seed)} % {high - low}::UBIGINT)::BIGINT + {low})"


def s_normal(key: str, salt: str, mean: float, sd: float, seed: int | str = SEED) -> str:
    a, b = s_unit(key, salt + "\0bm1", seed), s_unit(key, salt + "\0bm2", seed)
    return f"({float(mean)}::DOUBLE + {float(sd)}::DOUBLE * sqrt(-2.0::DOUBLE * ln(greatest({a}, 1e-12::DOUBLE))) * cos(6.283185307179586::DOUBLE * {b}))"


def s_pick(u: str, values: list[str], weights: list[float] | None = None) -> str:
    if weights is None:
        return f"([{', '.join(values)}])[least(floor({u} * {len(values)}), {len(values) - 1})::INT + 1]"
    sums = derive.checked_weights(len(values), weights)
    return "CASE " + " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN {v}" for c, v in zip(sums[:-1], values[:-1], strict=True)) + f" ELSE {values[-1]} END"


def s_id(key: str, tag: str, digits: int, prefix: str = "", seed: int | str = SEED) -> str:
    return f"'{prefix}' || lpad(({s_u64(key, 'id' + chr(0) + tag, seed)} % {10**digits}::UBIGINT)::VARCHAR, {digits}, '0')"


C = "'customer:' || c_custkey"

# ---- Derivation ----------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, round({s_unit(C, 'u')}, 12) AS u FROM customer")
def derive_unit(spark, d):
    return _customers(spark, d).select("c_custkey", F.round(derive.unit(F.col("key"), SEED, "u"), 12).alias("u"))


@query(f"SELECT c_custkey, ({s_u64(C, 'h')} % 1000000007::UBIGINT)::BIGINT AS h FROM customer")
def derive_u64_mod(spark, d):
    return _customers(spark, d).select("c_custkey", (derive.u64(F.col("key"), SEED, "h") % F.lit(1000000007).cast("decimal(20,0)")).cast("long").alias("h"))


@query(f"SELECT c_custkey, {s_int(C, 'i', -5, 17)} AS i FROM customer")
def derive_integers(spark, d):
    return _customers(spark, d).select("c_custkey", derive.integers(F.col("key"), SEED, "i", -5, 17).alias("i"))


@query(f"SELECT c_custkey, round({s_normal(C, 'n', 170, 10)}, 6) AS n FROM customer")
def derive_normal(spark, d):
    return _customers(spark, d).select("c_custkey", F.round(derive.normal(F.col("key"), SEED, "n", 170, 10), 6).alias("n"))


@query(f"SELECT c_custkey, {s_id(C, 'TIN', 9)} AS id FROM customer")
def derive_id(spark, d):
    return _customers(spark, d).select("c_custkey", derive.derive_id(F.col("key"), SEED, "TIN", digits=9).alias("id"))


@query(f"SELECT c_custkey, {s_id(C, 'ACC', 18, 'AC-')} AS id FROM customer")
def derive_id_prefix(spark, d):
    return _customers(spark, d).select("c_custkey", derive.derive_id(F.col("key"), SEED, "ACC", prefix="AC-", digits=18).alias("id"))


# ---- Rules ---------------------------------------------------------------------------------------------------------


def _ruled(spark, d, rule, *columns, round_to=None):
    out = rule.attach(_customers(spark, d, *columns), "v", "key", SEED, "rule")
    v = F.col("v") if round_to is None else F.round("v", round_to)
    return out.select("c_custkey", v.alias("v"))


@query("SELECT c_custkey, 'x' AS v FROM customer")
def rule_constant(spark, d):
    return _ruled(spark, d, dv.Constant("x"))


@query(f"SELECT c_custkey, {s_pick(s_unit(C, 'rule'), [repr(x) for x in 'abcde'])} AS v FROM customer")
def rule_choice_equal(spark, d):
    return _ruled(spark, d, dv.Choice(list("abcde")))


@query(f"SELECT c_custkey, {s_pick(s_unit(C, 'rule'), ['1::BIGINT', '2::BIGINT', '3::BIGINT', '4::BIGINT'], [0.5, 0.0, 0.2, 0.3])} AS v FROM customer")
def rule_choice_weighted(spark, d):
    return _ruled(spark, d, dv.Choice([1, 2, 3, 4], [0.5, 0.0, 0.2, 0.3]))


_MANY = [i % 7 + 1 for i in range(200)]


@query(f"SELECT c_custkey, len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in derive.checked_weights(200, _MANY))}], lambda c: c <= {s_unit(C, 'rule')}))::BIGINT AS v FROM customer")
def rule_choice_many(spark, d):
    return _ruled(spark, d, dv.Choice(list(range(200)), _MANY))


@query(f"SELECT c_custkey, {s_int(C, 'rule', 1960, 2005)} AS v FROM customer")
def rule_integer(spark, d):
    return _ruled(spark, d, dv.Integer(1960, 2005))


@query(f"SELECT c_custkey, round(-2.0::DOUBLE + {s_unit(C, 'rule')} * 5.0::DOUBLE, 9) AS v FROM customer")
def rule_uniform(spark, d):
    return _ruled(spark, d, dv.Uniform(-2, 3), round_to=9)


@query(f"SELECT c_custkey, round(least(greatest({s_normal(C, 'rule', 0, 10)}, -8.0::DOUBLE), 12.0::DOUBLE), 6) AS v FROM customer")
def rule_normal_clip(spark, d):
    return _ruled(spark, d, dv.Normal(0, 10, low=-8, high=12), round_to=6)


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN {s_int(C, 'rule', 0, 10)} WHEN 'BUILDING' THEN 7 WHEN 'FURNITURE' THEN {s_int(C, 'rule', 10, 20)}
WHEN 'HOUSEHOLD' THEN {s_pick(s_unit(C, 'rule'), ['30', '40'])} ELSE {s_int(C, 'rule', 50, 60)} END::BIGINT AS v FROM customer""")
def rule_conditional(spark, d):
    cases = {"AUTOMOBILE": dv.Integer(0, 10), "BUILDING": 7, "FURNITURE": dv.Integer(10, 20), "HOUSEHOLD": [30, 40], "MACHINERY": dv.Integer(50, 60)}
    return _ruled(spark, d, dv.Conditional("c_mktsegment", cases), "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE 'other' END AS v FROM customer")
def rule_conditional_default(spark, d):
    return _ruled(spark, d, dv.Conditional("c_mktsegment", {"BUILDING": "b"}, default="other"), "c_mktsegment")


@query(f"""WITH a AS (SELECT c_custkey, {s_pick(s_unit(C, 'table' + chr(0) + 't' + chr(0) + 'education'), ["'HS'", "'College'"], [0.6, 0.4])} AS education FROM customer),
b AS (SELECT *, CASE education WHEN 'HS' THEN {s_pick(s_unit(C, 'table' + chr(0) + 't' + chr(0) + 'sector'), ["'retail'", "'farm'"])} ELSE 'office' END AS sector FROM a)
SELECT c_custkey, education, sector, round(CASE sector WHEN 'retail' THEN {s_normal(C, 'table' + chr(0) + 't' + chr(0) + 'wage', 30000, 4000)} WHEN 'farm' THEN {s_normal(C, 'table' + chr(0) + 't' + chr(0) + 'wage', 26000, 3000)}
ELSE {s_normal(C, 'table' + chr(0) + 't' + chr(0) + 'wage', 60000, 9000)} END, 4) AS wage FROM b""")
def rule_conditional_chain(spark, d):
    from derivia.operators.generate import drawn

    rules = {  # declared against their dependencies
        "wage": dv.Conditional("sector", {"retail": dv.Normal(30000, 4000), "farm": dv.Normal(26000, 3000), "office": dv.Normal(60000, 9000)}),
        "sector": dv.Conditional("education", {"HS": ["retail", "farm"], "College": "office"}),
        "education": dv.Choice(["HS", "College"], [0.6, 0.4]),
    }
    out = drawn(_customers(spark, d), rules, "key", SEED, "table\0t")
    return out.select("c_custkey", "education", "sector", F.round("wage", 4).alias("wage"))


@query("SELECT c_custkey, round(c_acctbal * 2, 4) AS v FROM customer")
def rule_sequential(spark, d):
    return _ruled(spark, d, dv.Sequential("c_acctbal", lambda x: x * 2), "c_acctbal", round_to=4)


@query("SELECT c_custkey, upper(c_mktsegment) || '-' || (c_nationkey % 5) AS v FROM customer")
def rule_sequential_multi(spark, d):
    return _ruled(spark, d, dv.Sequential("c_mktsegment", lambda s, n: F.concat(F.upper(s), F.lit("-"), (n % 5).cast("string")), ("c_nationkey",)), "c_mktsegment", "c_nationkey")


# ---- Populations and grains ----------------------------------------------------------------------------------------


def _customer_entity(spark, d, **options):
    """The customers as an entity: as many as the table has, keyed by index."""
    return dv.Entity("person", _table(spark, d, "customer").count(), **options)


P = "'person:' || i"
N = "(SELECT range AS i FROM range((SELECT count(*) FROM customer)))"


def s_cov(table: str, share: float) -> str:
    return f"{s_unit(P, 'coverage' + chr(0) + table)} < {share}::DOUBLE"


@query(f"SELECT i AS idx, {P} AS key FROM {N}")
def population_scan(spark, d):
    from derivia.operators.generate import population

    return population(spark, "person", _table(spark, d, "customer").count()).select(F.col("_dv_index").alias("idx"), F.col(ENTITY_KEY).alias("key"))


def _run(schema, name, **options):
    return dv.Pipeline(schema, **options).run()[name]


EDU = dv.Choice(["HS", "College"], [0.6, 0.4])


def s_edu(entity: str = "person", key: str = P) -> str:
    return s_pick(s_unit(key, f"entity\0{entity}\0education"), ["'HS'", "'College'"], [0.6, 0.4])


S_TAX = s_id(P, "person\0tax_id", 12)


def _person(spark, d):
    return _customer_entity(spark, d, attributes={"education": EDU, "birth_year": dv.Integer(1960, 2005)}, identifiers=[dv.Identifier("tax_id", digits=12)])


@query(f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education, {s_int(P, 'entity' + chr(0) + 'person' + chr(0) + 'birth_year', 1960, 2005)} AS birth_year FROM {N}")
def grain_per_entity(spark, d):
    return _run(dv.Schema([_person(spark, d)], [dv.Table("roster", "person", carry="*", identifiers=["tax_id"])], SEED), "roster")


@query(f"SELECT {S_TAX} AS tax_id FROM {N} WHERE {s_cov('sub', 0.3)}")
def coverage_sample(spark, d):
    return _run(dv.Schema([_person(spark, d)], [dv.Table("sub", "person", identifiers=["tax_id"], coverage=0.3)], SEED), "sub")


@query(f"SELECT count(*) FILTER (a)::BIGINT AS a, count(*) FILTER (b)::BIGINT AS b, count(*) FILTER (a AND b)::BIGINT AS both FROM (SELECT {s_cov('a', 0.5)} AS a, {s_cov('b', 0.5)} AS b FROM {N})")
def coverage_two_tables(spark, d):
    schema = dv.Schema([_person(spark, d)], [dv.Table(t, "person", identifiers=["tax_id"], coverage=0.5) for t in "ab"], SEED)
    t = dv.Pipeline(schema).run().tables
    a, b = t["a"].withColumn("ina", F.lit(1)), t["b"].withColumn("inb", F.lit(1))
    return a.join(b, "tax_id", "full").agg(F.count("ina").alias("a"), F.count("inb").alias("b"), F.count(F.col("ina") + F.col("inb")).alias("both"))


_WAGE = dv.Conditional("education", {"HS": dv.Normal(38000, 5000, low=0), "College": dv.Normal(64000, 8000, low=0)})


def s_wage(table: str, key: str, round_to: int = 4) -> str:
    salt = f"table\0{table}\0wage"
    return f"round(CASE education WHEN 'HS' THEN greatest({s_normal(key, salt, 38000, 5000)}, 0.0::DOUBLE) ELSE greatest({s_normal(key, salt, 64000, 8000)}, 0.0::DOUBLE) END, {round_to})"


_PANEL = f"(SELECT i, p AS period, {P} AS e, {P} || '|' || p AS r FROM {N}, (SELECT unnest([2020, 2021, 2022]) AS p))"
E_TAX = s_id("e", "person\0tax_id", 12)


def _rounded(df, column="wage", to=4):
    return df.withColumn(column, F.round(column, to))


@query(f"SELECT {E_TAX} AS tax_id, period::BIGINT AS period, education, {s_wage('wages', 'r')} AS wage FROM (SELECT *, {s_edu(key='e')} AS education FROM {_PANEL})")
def grain_per_period(spark, d):
    t = dv.Table("wages", dv.PerPeriod("person", [2020, 2021, 2022]), {"wage": _WAGE}, carry=["education"], identifiers=["tax_id"])
    return _rounded(_run(dv.Schema([_person(spark, d)], [t], SEED), "wages"))


@query(f"SELECT {E_TAX} AS tax_id, period::BIGINT AS period FROM {_PANEL} WHERE {s_unit('r', 'presence' + chr(0) + 'panel')} < 0.5::DOUBLE")
def grain_per_period_presence(spark, d):
    return _run(dv.Schema([_person(spark, d)], [dv.Table("panel", dv.PerPeriod("person", [2020, 2021, 2022], presence=0.5), identifiers=["tax_id"])], SEED), "panel")


def s_events(table: str, low: int, high: int) -> str:
    return f"(SELECT i, e, unnest(range(n)) AS occurrence FROM (SELECT i, {P} AS e, {s_int(P, 'events' + chr(0) + table, low, high)} AS n FROM {N}))"


@query(f"SELECT {E_TAX} AS tax_id, occurrence, round({s_unit('''e || '|' || occurrence''', 'table' + chr(0) + 'visits' + chr(0) + 'cost')} * 500.0::DOUBLE, 6) AS cost FROM {s_events('visits', 1, 6)}")
def grain_per_event(spark, d):
    t = dv.Table("visits", dv.PerEvent("person", 1, 6), {"cost": dv.Uniform(0, 500)}, identifiers=["tax_id"])
    return _rounded(_run(dv.Schema([_person(spark, d)], [t], SEED), "visits"), "cost", 6)


@query(f"SELECT {E_TAX} AS tax_id, occurrence FROM {s_events('rare', 0, 3)}")
def grain_per_event_zero(spark, d):
    return _run(dv.Schema([_person(spark, d)], [dv.Table("rare", dv.PerEvent("person", 0, 3), identifiers=["tax_id"])], SEED), "rare")


@query(f"SELECT CASE WHEN {s_edu()} = 'HS' THEN 20 ELSE 40 END::BIGINT AS wage FROM {N}")
def carry_transitive(spark, d):
    e = _customer_entity(spark, d, attributes={"education": EDU, "sector": dv.Conditional("education", {"HS": "a", "College": "b"}), "wage": dv.Conditional("sector", {"a": 20, "b": 40})})
    return _run(dv.Schema([e], [dv.Table("t", "person", carry=["wage"])], SEED), "t")


# ---- Linkage -------------------------------------------------------------------------------------------------------


def _linked(spark, d):
    tables = [dv.Table("k12", "person", carry=["education"], identifiers=["tax_id"], coverage=0.7), dv.Table("dmv", "person", carry=["birth_year"], identifiers=["tax_id"], coverage=0.6)]
    return dv.Pipeline(dv.Schema([_person(spark, d)], tables, SEED)).run().tables


@query(f"SELECT {S_TAX} AS tax_id, {s_id(P, 'person' + chr(0) + 'ssn', 12)} AS ssn FROM {N}")
def link_ids(spark, d):
    e = _customer_entity(spark, d, identifiers=[dv.Identifier("tax_id", digits=12), dv.Identifier("ssn", digits=12)])
    return _run(dv.Schema([e], [dv.Table("ids", "person", identifiers=["tax_id", "ssn"])], SEED), "ids")


@query(f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education, {s_int(P, 'entity' + chr(0) + 'person' + chr(0) + 'birth_year', 1960, 2005)} AS birth_year FROM {N} WHERE {s_cov('k12', 0.7)} AND {s_cov('dmv', 0.6)}")
def link_join_inner(spark, d):
    t = _linked(spark, d)
    return t["k12"].join(t["dmv"], "tax_id")


@query(f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education FROM {N} WHERE {s_cov('k12', 0.7)} AND NOT {s_cov('dmv', 0.6)}")
def link_left_anti(spark, d):
    t = _linked(spark, d)
    return t["k12"].join(t["dmv"], "tax_id", "left_anti")


@query(f"SELECT {S_TAX} AS tax_id, {s_edu()} AS education FROM {N} WHERE {s_cov('k12', 0.7)} AND {s_cov('dmv', 0.6)}")
def link_left_semi(spark, d):
    t = _linked(spark, d)
    return t["k12"].join(t["dmv"], "tax_id", "left_semi")


@query(f"""SELECT {S_TAX} AS tax_id, CASE WHEN {s_cov('k12', 0.7)} THEN {s_edu()} END AS education, CASE WHEN {s_cov('dmv', 0.6)} THEN {s_int(P, 'entity' + chr(0) + 'person' + chr(0) + 'birth_year', 1960, 2005)} END AS birth_year
FROM {N} WHERE {s_cov('k12', 0.7)} OR {s_cov('dmv', 0.6)}""")
def link_join_full(spark, d):
    t = _linked(spark, d)
    return t["k12"].join(t["dmv"], "tax_id", "full")


@query(f"SELECT {S_TAX} AS tax_id FROM {N} WHERE {s_cov('k12', 0.7)} AND {s_cov('dmv', 0.6)}")
def link_intersect(spark, d):
    t = _linked(spark, d)
    return t["k12"].select("tax_id").intersect(t["dmv"].select("tax_id"))


@query(f"SELECT {S_TAX} AS tax_id FROM {N} WHERE {s_cov('k12', 0.7)} AND NOT {s_cov('dmv', 0.6)}")
def link_subtract(spark, d):
    t = _linked(spark, d)
    return t["k12"].select("tax_id").subtract(t["dmv"].select("tax_id"))


@query(f"""SELECT 'person' AS entity, {S_TAX} AS tax_id, {s_edu()} AS education FROM {N}
UNION ALL SELECT 'firm', {s_id("'firm:' || i", 'firm' + chr(0) + 'tax_id', 12)}, {s_edu('firm', "'firm:' || i")} FROM (SELECT range AS i FROM range((SELECT count(*) FROM supplier)))""")
def link_two_entities(spark, d):
    ids = [dv.Identifier("tax_id", digits=12)]
    entities = [_customer_entity(spark, d, attributes={"education": EDU}, identifiers=ids), dv.Entity("firm", _table(spark, d, "supplier").count(), {"education": EDU}, ids)]
    t = dv.Pipeline(dv.Schema(entities, [dv.Table(f"{e.name}s", e.name, carry="*", identifiers=["tax_id"]) for e in entities], SEED)).run().tables
    both = [t[f"{e.name}s"].select(F.lit(e.name).alias("entity"), "tax_id", "education") for e in entities]
    return both[0].unionByName(both[1])


# ---- Noise ---------------------------------------------------------------------------------------------------------


def _noised(spark, d, table, key, column, *ops):
    from derivia.operators.noise import corrupted

    df = _table(spark, d, table)
    df = df.select(key, *[c for c in (column, "c_mktsegment") if c in df.columns]).withColumn("_dv_row", F.concat(F.lit(f"{table}:"), F.col(key).cast("string")))
    for op in ops:
        df, _ = corrupted(df, column, op, SEED, f"noise\0{table}\0{column}\0{op.name}")
    return df.select(key, F.col(column).alias("v"))


def s_hit(table: str, key: str, column: str, op: str) -> str:
    return s_unit(f"'{table}:' || {key}", f"noise\0{table}\0{column}\0{op}")


def s_pos(table: str, key: str, column: str, op: str) -> str:
    return s_unit(f"'{table}:' || {key}", f"noise\0{table}\0{column}\0{op}\0pos")


def s_typo(table: str, key: str, column: str, rate: float) -> str:
    from derivia.operators.noise import NEIGHBOURS

    keyboard = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in NEIGHBOURS.items()) + "}"
    return f"""WITH a AS (SELECT {key}, {column} AS t, {s_hit(table, key, column, 'typo')} < {rate}::DOUBLE AS hit, least(floor({s_pos(table, key, column, 'typo')} * length({column})), length({column}) - 1)::INT AS j FROM {table}),
b AS (SELECT *, t[j+1] AS c, t[j+2] AS nxt, CASE WHEN j > 0 THEN t[j] ELSE '' END AS prv, ({keyboard})[lower(t[j+1])] AS o FROM a)
SELECT {key}, CASE WHEN NOT hit OR t IS NULL OR t = '' THEN t
WHEN o IS NOT NULL THEN t[:j] || CASE WHEN c = lower(c) THEN o[j % length(o) + 1] ELSE upper(o[j % length(o) + 1]) END || t[j+2:]
WHEN nxt <> '' AND nxt <> c THEN t[:j] || nxt || c || t[j+3:]
WHEN prv <> '' AND prv <> c THEN t[:j-1] || c || prv || t[j+2:]
ELSE t[:j] || c || c || t[j+2:] END AS v FROM b"""


@query(f"SELECT c_custkey, CASE WHEN {s_hit('customer', 'c_custkey', 'c_name', 'missing')} < 0.3::DOUBLE THEN NULL ELSE c_name END AS v FROM customer")
def noise_missing(spark, d):
    return _noised(spark, d, "customer", "c_custkey", "c_name", Missing(0.3))


@query(f"SELECT c_custkey, CASE WHEN {s_hit('customer', 'c_custkey', 'c_acctbal', 'missing')} < CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END THEN NULL ELSE c_acctbal END AS v FROM customer")
def noise_missing_rowrate(spark, d):
    return _noised(spark, d, "customer", "c_custkey", "c_acctbal", Missing(lambda row: F.when(row["c_mktsegment"] == "BUILDING", 0.3).otherwise(0.05)))


@query(s_typo("part", "p_partkey", "p_name", 0.5))
def noise_typo(spark, d):
    return _noised(spark, d, "part", "p_partkey", "p_name", Typo(0.5))


@query(s_typo("documents", "doc_id", "text", 0.9))
def noise_typo_unicode(spark, d):
    return _noised(spark, d, "documents", "doc_id", "text", Typo(0.9))


@query("""WITH a AS (SELECT c_custkey, c_name AS t, """ + s_hit("customer", "c_custkey", "c_name", "ocr") + """ < 0.6::DOUBLE AS hit, """ + s_pos("customer", "c_custkey", "c_name", "ocr") + """ AS u,
list_filter(range(1, length(c_name) + 1), lambda i: contains('0O1Il5S8B2Z6G', c_name[i])) AS spots FROM customer),
b AS (SELECT *, spots[least(floor(u * len(spots)), len(spots) - 1)::INT + 1]::INT AS i FROM a)
SELECT c_custkey, CASE WHEN hit AND len(spots) > 0 THEN t[:i-1] || translate(t[i], '0O1Il5S8B2Z6G', 'O0I11S5B8Z2G6') || t[i+1:] ELSE t END AS v FROM b""")
def noise_ocr(spark, d):
    return _noised(spark, d, "customer", "c_custkey", "c_name", OCR(0.6))


@query(f"SELECT 'value.missing' AS op, round(avg(CASE WHEN {s_unit(P, 'noise' + chr(0) + 't' + chr(0) + 'value' + chr(0) + 'missing')} < 0.2::DOUBLE THEN 1 ELSE 0 END), 9) AS rate FROM {N}")
def noise_realized_rate(spark, d):
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"value": dv.Uniform(0, 1)})], SEED)
    facts = dv.Pipeline(schema, noiser=Noise({"t": {"value": [Missing(0.2)]}})).run().metadata["t"]["noise"]
    return spark.createDataFrame([(k, round(v, 9)) for k, v in facts.items()], "op string, rate double")


@query(f"SELECT CASE WHEN {s_unit(P, 'noise' + chr(0) + 't' + chr(0) + 'tax_id' + chr(0) + 'missing')} < 0.25::DOUBLE THEN NULL ELSE {S_TAX} END AS tax_id FROM {N}")
def noise_identifier(spark, d):
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", identifiers=["tax_id"])], SEED)
    return _run(schema, "t", noiser=Noise({"t": {"tax_id": [Missing(0.25)]}}))


# ---- Structure and synthesis ---------------------------------------------------------------------------------------


def s_prior(rows: int, table: str) -> str:
    return f"(SELECT 'prior:{table}:' || range AS k FROM range({rows}))"


_OWN = {"tenure": {"own": 0.65, "rent": 0.35}, "income": {25000: 0.5, 75000: 0.5}}


def _training(spark, prior, table="t"):
    from derivia.plans.context import RunContext

    schema = dv.Schema([dv.Entity("person", 1)], [dv.Table(table, "person")], SEED)
    return prior.training_frame(schema.tables[0], RunContext(spark, schema)).drop("_dv_position")


@query(f"""SELECT {s_pick(s_unit('k', 'prior' + chr(0) + 'tenure'), ["'own'", "'rent'"], [0.65, 0.35])} AS tenure, {s_pick(s_unit('k', 'prior' + chr(0) + 'income'), ['25000::BIGINT', '75000::BIGINT'], [0.5, 0.5])} AS income FROM {s_prior(5000, 't')}""")
def prior_marginal(spark, d):
    return _training(spark, dv.Prior(_OWN, rows=5000))


_CELLS = {("HS", "yes"): 0.30, ("HS", "no"): 0.30, ("College", "yes"): 0.38, ("College", "no"): 0.02}


@query(f"""SELECT split_part(c, '|', 1) AS education, split_part(c, '|', 2) AS employed FROM (SELECT {s_pick(s_unit('k', 'prior' + chr(0) + 'education' + chr(0) + 'employed'), ["'HS|yes'", "'HS|no'", "'College|yes'", "'College|no'"], list(_CELLS.values()))} AS c FROM {s_prior(2000, 't')})""")
def prior_joint(spark, d):
    return _training(spark, dv.Prior({"education": {"HS": 0.6, "College": 0.4}}, {("education", "employed"): _CELLS}, rows=2000))


def s_synth(table: str, column: str) -> tuple[str, str]:
    return f"synth\0{table}\0{column}", P


@query(f"""WITH donors AS (SELECT o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT round(price, 4) AS price FROM (SELECT {s_unit(P, 'x')} AS x, ({s_u64(P, 'synth' + chr(0) + 't' + chr(0) + 'price')} % (SELECT count(*) FROM orders)::UBIGINT)::BIGINT AS pos FROM {N}) JOIN donors USING (pos)""")
def empirical_marginal_draw(spark, d):
    donors = _table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"price": 0.0})], SEED)
    cart = CARTSynthesizer(["price"], structure=dv.Empirical(donors, order_by=["o_orderkey"]))
    return _rounded(_run(schema, "t", synthesizer=cart), "price")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_S_PRIORITY = s_pick(s_unit(P, "entity\0person\0priority"), [f"'{p}'" for p in _PRIORITIES])


@query(f"""WITH donors AS (SELECT o_orderpriority AS priority, c_nationkey::BIGINT AS nation, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
rows_ AS (SELECT i, {_S_PRIORITY} AS priority, {s_unit(P, 'synth' + chr(0) + 't' + chr(0) + 'nation')} AS u FROM {N})
SELECT r.priority, d.nation FROM rows_ r JOIN donors d ON d.priority = r.priority AND d.pos = least(floor(r.u * d.n), d.n - 1)""")
def cart_group_donor(spark, d):
    """Unlimited depth over one category: a leaf for each, so synthesis draws a donor from the row's own group."""
    donors = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("c_nationkey").cast("long").alias("nation"))
    e = _customer_entity(spark, d, attributes={"priority": dv.Choice(_PRIORITIES)})
    schema = dv.Schema([e], [dv.Table("t", "person", {"nation": 0}, carry=["priority"])], SEED)
    cart = CARTSynthesizer(["nation"], predictors=["priority"], structure=dv.Empirical(donors, order_by=["o_orderkey"]), min_samples_leaf=1, max_depth=None)
    # Codes, which the tree may split at every step, tell the groups apart where their means differ, as they do here.
    return _run(schema, "t", synthesizer=cart)


@query()
def cart_chain(spark, d):
    """Two synthesizers in a row, the second conditioned on what the first made."""
    donors = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    schema = dv.Schema([_person(spark, d)], [dv.Table("t", "person", {"l_returnflag": "", "l_linestatus": "", "l_quantity": 0.0})], SEED)
    from derivia.operators.synthesize import ChainedSynthesizer

    order = dv.Empirical(donors, order_by=["l_orderkey", "l_linenumber"])
    chain = ChainedSynthesizer([CARTSynthesizer(["l_returnflag", "l_linestatus"], structure=order), CARTSynthesizer(["l_quantity"], predictors=["l_returnflag", "l_linestatus"], structure=order, label="second")])
    return _run(schema, "t", synthesizer=chain)


@query()
def mode_real_data(spark, d):
    """The front door over real rows, columns of two epsilons."""
    mode = dv.Mode.real_data(_table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), epsilon=2.0, spark=spark)
    e = mode.entity("person", count=1000, attributes={"c_mktsegment": mode.attribute("c_mktsegment"), "c_acctbal": mode.attribute("c_acctbal", epsilon=0.5)})
    return mode.schema(entities=[e], tables=[mode.table("t", grain="person", carry="*")], seed=SEED).run()["t"]


@query(f"SELECT {s_pick(s_unit(P, 'entity' + chr(0) + 'person' + chr(0) + 'grade'), [repr(x) for x in 'ABC'], [0.5, 0.3, 0.2])} AS grade, round({s_unit(P, 'entity' + chr(0) + 'person' + chr(0) + 'score')} * 100.0::DOUBLE, 6) AS score FROM (SELECT range AS i FROM range(500))")
def mode_metadata(spark, d):
    mode = dv.Mode.metadata(spark)
    e = mode.entity("person", count=500, attributes={"grade": mode.attribute("grade", values=list("ABC"), weights=[0.5, 0.3, 0.2]), "score": mode.attribute("score", min=0, max=100)})
    return _rounded(mode.schema(entities=[e], tables=[mode.table("t", grain="person", carry="*")], seed=SEED).run()["t"], "score", 6)


# ---- Fidelity ------------------------------------------------------------------------------------------------------


def _flags(spark, d):
    t = _table(spark, d, "lineitem")
    return t.filter("l_returnflag = 'R'"), t.filter("l_returnflag = 'A'")


@query("""WITH a AS (SELECT l_linestatus v, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_linestatus v, count(*) m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT round(sum(abs(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM a) - coalesce(m, 0)::DOUBLE / (SELECT sum(m) FROM b))) / 2, 9) AS delta FROM a FULL JOIN b USING (v)""")
def fid_share_delta(spark, d):
    return fidelity.share_delta(*_flags(spark, d), "l_linestatus").select(F.round("delta", 9).alias("delta"))


@query("""WITH v AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'R') AS x, count(*) FILTER (l_returnflag = 'A') AS y FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1),
c AS (SELECT sum(x) OVER w / sum(x) OVER ()::DOUBLE AS f, sum(y) OVER w / sum(y) OVER ()::DOUBLE AS g FROM v WINDOW w AS (ORDER BY v))
SELECT round(max(abs(f - g)), 9) AS statistic, (SELECT sum(x) FROM v)::BIGINT AS n, (SELECT sum(y) FROM v)::BIGINT AS m FROM c""")
def fid_ks(spark, d):
    return fidelity.ks(*_flags(spark, d), "l_extendedprice").select(F.round("statistic", 9).alias("statistic"), F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS value FROM lineitem")
def fid_pearson(spark, d):
    return fidelity.pearson(_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("value", 9).alias("value"))


@query("""WITH o AS (SELECT l_returnflag a, l_linestatus b, count(*) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(o) AS r FROM o GROUP BY 1), c AS (SELECT b, sum(o) AS c FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o)
SELECT round(sqrt(sum((coalesce(o, 0) - r * c / n::DOUBLE) ** 2 / (r * c / n::DOUBLE)) / any_value(n) / (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1)), 6) AS value
FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b""")
def fid_cramers_v(spark, d):
    return fidelity.cramers_v(_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("value", 6).alias("value"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1), t AS (SELECT avg(value) AS m, sum((value - (SELECT avg(value) FROM events)) ** 2) AS ss FROM events)
SELECT round(sqrt(sum(n * (g.m - t.m) ** 2) / any_value(t.ss)), 6) AS value FROM g CROSS JOIN t""")
def fid_eta(spark, d):
    return fidelity.correlation_ratio(_table(spark, d, "events"), "event_type", "value").select(F.round("value", 6).alias("value"))


# ---- Governance ----------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('roster', (SELECT count(*) FROM customer)::BIGINT, 3::BIGINT), ('wages', (2 * (SELECT count(*) FROM customer))::BIGINT, 2::BIGINT)) t(\"table\", \"rows\", \"columns\")")
def summary_counts(spark, d):
    tables = [dv.Table("roster", "person", carry="*", identifiers=["tax_id"]), dv.Table("wages", dv.PerPeriod("person", [2020, 2021]), identifiers=["tax_id"])]
    return dv.Pipeline(dv.Schema([_person(spark, d)], tables, SEED)).run().summary()


# ---- Reference data ------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, printf('%03d-%02d-%04d', CASE WHEN a >= 666 THEN a + 1 ELSE a END, g, s) AS v FROM (SELECT c_custkey, {s_int(C, 'rule' + chr(0) + 'area', 1, 899)} AS a, {s_int(C, 'rule' + chr(0) + 'group', 1, 100)} AS g, {s_int(C, 'rule' + chr(0) + 'serial', 1, 10000)} AS s FROM customer)""")
def ssn_format(spark, d):
    return _ruled(spark, d, people.SSN())


_PLACES = [("99553", "Akutan", "Alaska", "AK"), ("99571", "Cold Bay", "Alaska", "AK"), ("10001", "New York", "New York", "NY")]


@query(f"""SELECT c_custkey, (['Akutan', 'Cold Bay', 'New York'])[p] AS city, (['AK', 'AK', 'NY'])[p] AS state_abbr FROM (SELECT c_custkey, {s_int(C, 'usaddress' + chr(0) + 'home', 0, 3)} + 1 AS p FROM customer)""")
def us_address_row(spark, d):
    places = spark.createDataFrame([(c, z, s, a) for z, c, s, a in _PLACES], "city string, postal_code string, state string, state_abbr string")
    df = _customers(spark, d)
    for field in ("city", "state_abbr"):
        df = people.USAddress(field, "home", places=places).attach(df, field, "key", SEED, "rule")
    return df.select("c_custkey", "city", "state_abbr")


_SURNAMES = [("SMITH", 1000, 70.0, 10.0), ("NGUYEN", 400, 2.0, 90.0), ("GONZALEZ", 600, 5.0, 1.0)]


def _pool_sql(groups: str, pools: dict[str, dict[str, float]]) -> str:
    """A pick from one of several pools, their values in order of name."""
    u = s_unit(C, "rule")
    cases = []
    for group, pool in pools.items():
        names = sorted(pool)
        total, sums, acc = sum(pool.values()), [], 0.0
        for n in names:
            acc += pool[n]
            sums.append(acc / total)
        cases.append(f"WHEN '{group}' THEN CASE " + " ".join(f"WHEN {u} < {c!r}::DOUBLE THEN '{n}'" for c, n in zip(sums[:-1], names[:-1], strict=True)) + f" ELSE '{names[-1]}' END")
    return f"SELECT c_custkey, CASE {groups} {' '.join(cases)} END AS v FROM customer"


@query(_pool_sql("CASE WHEN c_nationkey < 12 THEN 'w' ELSE 'a' END", {"w": {n: c * w / 100 for n, c, w, _ in _SURNAMES}, "a": {n: c * a / 100 for n, c, _, a in _SURNAMES}}))
def surname_by_race(spark, d):
    shares = ", ".join(f"{c} double" for c in people.SURNAME_SHARES)
    data = spark.createDataFrame([(n, c, w, 0.0, a, 0.0, 0.0, 0.0) for n, c, w, a in _SURNAMES], f"name string, count long, {shares}")
    df = _customers(spark, d, "c_nationkey").withColumn("race", F.when(F.col("c_nationkey") < 12, "w").otherwise("a"))
    return people.Surname("race", {"w": "pctwhite", "a": "pctapi"}, source=data).attach(df, "v", "key", SEED, "rule").select("c_custkey", "v")


_YEARLY = {"1900": {"Mary": 400, "John": 350, "William": 200}, "2020": {"Noah": 300, "Olivia": 280, "Emma": 260}}


@query(_pool_sql("CASE WHEN c_nationkey < 12 THEN '1900' ELSE '2020' END", _YEARLY))
def name_by_year(spark, d):
    data = spark.createDataFrame([(int(y), n, "F", c) for y, pool in _YEARLY.items() for n, c in pool.items()], "year int, name string, sex string, count long")
    df = _customers(spark, d, "c_nationkey").withColumn("birth_year", F.when(F.col("c_nationkey") < 12, 1900).otherwise(2020))
    return people.SSAFirstName(source=data).attach(df, "v", "key", SEED, "rule").select("c_custkey", "v")


@query(_pool_sql("'all'", {"all": {"Ann": 3.0, "Bob": 1.0, "Cid": 2.0}}))
def name_pool(spark, d):
    pool = spark.createDataFrame([("Ann", 3.0), ("Bob", 1.0), ("Cid", 2.0)], "value string, weight double")
    return PoolChoice(pool).attach(_customers(spark, d), "v", "key", SEED, "rule").select("c_custkey", "v")


@query("SELECT * FROM (VALUES ('NY', '36'), ('New York', '36'), ('6', '06'), ('puerto rico', '72')) t(state, fips)")
def pums_states(spark, d):
    return spark.createDataFrame([(s, pums.resolve_state(s)) for s in ("NY", "New York", "6", "puerto rico")], "state string, fips string")


# ---- All stages ----------------------------------------------------------------------------------------------------


def flagship_schema(count: int) -> dv.Schema:
    person = dv.Entity("person", count, {"education": EDU, "birth_year": dv.Integer(1960, 2005)}, [dv.Identifier("tax_id", digits=16)])
    wages = dv.Table("wages", dv.PerPeriod("person", list(range(2018, 2026)), presence=0.8), {"wage": _WAGE}, carry=["education"], identifiers=["tax_id"], coverage=0.7)
    return dv.Schema([person], [wages], SEED)


@query(f"""SELECT {s_id('e', 'person' + chr(0) + 'tax_id', 16)} AS tax_id, period::BIGINT AS period, education, CASE WHEN {s_unit('r', 'noise' + chr(0) + 'wages' + chr(0) + 'wage' + chr(0) + 'missing')} < 0.05::DOUBLE THEN NULL ELSE {s_wage('wages', 'r')} END AS wage
FROM (SELECT *, {s_edu(key='e')} AS education FROM (SELECT i, p AS period, {P} AS e, {P} || '|' || p AS r FROM {N}, (SELECT unnest(range(2018, 2026)) AS p) WHERE {s_cov('wages', 0.7)}))
WHERE {s_unit('r', 'presence' + chr(0) + 'wages')} < 0.8::DOUBLE""")
def panel_flagship(spark, d):
    schema = flagship_schema(_table(spark, d, "customer").count())
    return _rounded(_run(schema, "wages", noiser=Noise({"wages": {"wage": [Missing(0.05)]}})))
