"""Names, addresses and social security numbers from published frequencies."""

from __future__ import annotations

import io
import math
import numbers
import os
import zipfile
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.functions import derive
from derivia.functions.rules import PoolChoice, Rule
from derivia.sources.fetch import CACHE, cached_frame, fetch_url

GEONAMES = "https://download.geonames.org/export/zip/US.zip"
SSA_NAMES = "https://www.ssa.gov/oact/babynames/names.zip"
SURNAMES = "https://www2.census.gov/topics/genealogy/2010surnames/names.zip"

# Columns of the published files.
POSTAL_COLUMNS = ("country_code", "postal_code", "city", "state", "state_abbr", "county", "county_code", "admin_name3", "admin_code3", "latitude", "longitude", "accuracy")
ADDRESS_FIELDS = ("city", "state", "state_abbr", "postal_code", "county", "latitude", "longitude")
SURNAME_SHARES = ("pctwhite", "pctblack", "pctapi", "pctaian", "pct2prace", "pcthispanic")
NAME_POOLS = {"first_name": "first_names", "first_name_female": "first_names_female", "first_name_male": "first_names_male", "last_name": "last_names"}


def archive_lines(spark: SparkSession, source: str | os.PathLike | None, url: str, label: str, wanted: Callable[[str], bool]) -> DataFrame:
    """file, number (from 0), line of the wanted members of a zip archive: a path that Spark reads, else downloaded.

    The archive is unpacked by the task that reads it and leaves no files behind. The published ones have a few megabytes.
    """
    if source:
        archives = spark.read.format("binaryFile").load(os.fspath(source)).select("content")
    else:
        archives = spark.createDataFrame([(bytearray(fetch_url(url, label=label)),)], "content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in filter(lambda n: wanted(n.rpartition("/")[2]), z.namelist()):
                        lines = z.read(name).decode("utf-8-sig").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * len(lines)), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], ["file", "number", "line"])

    found = archives.mapInArrow(run, "file string, number int, line string")
    if found.isEmpty():
        raise RuntimeError(f"{label}: the archive has no file of the expected name")
    return found


_POSTAL = ", ".join(f"{c} string" for c in POSTAL_COLUMNS)
_YEARLY = "name string, sex string, count long"


def read_postal(spark: SparkSession, path: str) -> DataFrame:
    """A GeoNames postal file: tab-separated, without quoting, all text."""
    return spark.read.csv(path, sep="\t", quote="", schema=_POSTAL)


def read_yearly_names(spark: SparkSession, paths: Any) -> DataFrame:
    """year, name, sex, count of `yob<year>.txt` files; the year is in the file's name."""
    return _of_years(spark.read.csv(paths, schema=_YEARLY).select("name", "sex", "count", F.col("_metadata.file_name").alias("file")))


def _of_years(named: DataFrame) -> DataFrame:
    return named.select(F.regexp_extract("file", r"yob(\d+)\.txt", 1).cast("int").alias("year"), "name", "sex", "count")


def read_surnames(spark: SparkSession, path: str) -> DataFrame:
    """name, count and the shares of a census surname file; suppressed shares count as 0, the row of all others goes."""
    return _with_shares(spark.read.csv(path, header=True))


def _with_shares(raw: DataFrame) -> DataFrame:
    shares = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in SURNAME_SHARES]
    return raw.filter(F.coalesce(F.col("name"), F.lit("")) != "ALL OTHER NAMES").select("name", F.col("count").try_cast("long").alias("count"), *shares)


def _zipped_postal(spark: SparkSession, source: Any) -> DataFrame:
    lines = archive_lines(spark, source, GEONAMES, "GeoNames", lambda n: n == "US.txt")
    return lines.select(F.from_csv("line", F.lit(_POSTAL), {"sep": "\t", "quote": ""}).alias("r")).select("r.*")


def _zipped_names(spark: SparkSession, source: Any) -> DataFrame:
    lines = archive_lines(spark, source, SSA_NAMES, "SSA names", lambda n: n.startswith("yob") and n.endswith(".txt"))
    return _of_years(lines.select(F.from_csv("line", F.lit(_YEARLY)).alias("r"), "file").select("r.*", "file"))


def _zipped_surnames(spark: SparkSession, source: Any) -> DataFrame:
    lines = archive_lines(spark, source, SURNAMES, "census surnames", lambda n: n == "Names_2010Census.csv")
    header = lines.filter("number = 0").first()["line"].split(",")  # one row
    return _with_shares(lines.filter("number > 0").select(F.from_csv("line", F.lit(", ".join(f"`{c}` string" for c in header))).alias("r")).select("r.*"))


def _published(spark: SparkSession, source: Any, cache_dir: Any, name: str, plain: Callable[..., DataFrame], zipped: Callable[..., DataFrame]) -> DataFrame:
    """A frame as given, a plain file or folder, or a zip archive (given or downloaded) through the cache."""
    if isinstance(source, DataFrame):
        return source
    if source and not os.fspath(source).endswith(".zip"):
        return plain(spark, os.fspath(source))
    return cached_frame(spark, f"{name}:{source}", lambda: zipped(spark, source), cache_dir)


def postal_data(spark: SparkSession, source: Any = None, cache_dir: str | os.PathLike | None = CACHE / "geonames") -> DataFrame:
    return _published(spark, source, cache_dir, "geonames", read_postal, _zipped_postal)


def yearly_names(spark: SparkSession, source: Any = None, cache_dir: str | os.PathLike | None = CACHE / "ssa_names") -> DataFrame:
    return _published(spark, source, cache_dir, "ssa", read_yearly_names, _zipped_names)


def surnames(spark: SparkSession, source: Any = None, cache_dir: str | os.PathLike | None = CACHE / "census_surnames") -> DataFrame:
    return _published(spark, source, cache_dir, "surnames", read_surnames, _zipped_surnames)


class USAddress(Rule):
    """A field of a real postal place. Rules of one group give fields of the same place for a key."""

    def __init__(self, field: str, group: str = "address", *, places: DataFrame | None = None, spark: SparkSession | None = None):
        if field not in ADDRESS_FIELDS:
            raise ValueError(f"field must be one of {ADDRESS_FIELDS}, got {field!r}")
        self.field, self.group = field, group
        self.places = places if places is not None else postal_data(spark or SparkSession.builder.getOrCreate())
        self._count: int | None = None

    def spark_type(self) -> str | None:
        return "string"

    def attach(self, df, name, key, seed, salt):
        from pyspark.sql import Window

        if self._count is None:
            self._count = self.places.count()
        # Places are numbered in the order of their content; the file has tens of thousands.
        order = Window.orderBy(*[F.col(c) for c in self.places.columns])
        numbered = self.places.select((F.row_number().over(order) - 1).cast("long").alias("_dv_no"), F.col(self.field).cast("string").alias("_dv_field"))
        drawn = df.withColumn("_dv_no", derive.integers(F.col(key), seed, f"usaddress\0{self.group}", 0, self._count))
        return drawn.join(numbered, "_dv_no", "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("_dv_field").alias(name))


class SSAFirstName(PoolChoice):
    """A first name by year of birth, and by sex if sex_on is given. A null or unknown year fails the job."""

    def __init__(self, on: str = "birth_year", sex_on: str | None = None, source: Any = None, spark: SparkSession | None = None):
        data = yearly_names(spark or SparkSession.builder.getOrCreate(), source)
        group = F.col("year").cast("string") if sex_on is None else F.concat_ws("|", F.col("year").cast("string"), "sex")
        super().__init__(data.select(group.alias("group"), F.col("name").alias("value"), F.col("count").alias("weight")), on=on)
        self.sex_on = sex_on

    def depends_on(self):
        return (self.on, self.sex_on) if self.sex_on else (self.on,)

    def attach(self, df, name, key, seed, salt):
        if not self.sex_on:
            return super().attach(df, name, key, seed, salt)
        both = PoolChoice(self.pool, on="_dv_cohort")
        keyed = df.withColumn("_dv_cohort", F.when(F.col(f"`{self.on}`").isNotNull(), F.concat_ws("|", F.col(f"`{self.on}`").cast("string"), F.col(f"`{self.sex_on}`"))))
        return both.attach(keyed, name, key, seed, salt).drop("_dv_cohort")


class Surname(PoolChoice):
    """A last name by a race or ethnicity column; categories maps its values to the census file's shares."""

    def __init__(self, on: str, categories: Mapping[str, str], source: Any = None, spark: SparkSession | None = None):
        if not categories:
            raise ValueError("Surname needs categories")
        if unknown := sorted(set(categories.values()) - set(SURNAME_SHARES)):
            raise ValueError(f"categories name unknown shares {unknown}; known: {SURNAME_SHARES}")
        data = surnames(spark or SparkSession.builder.getOrCreate(), source)
        each = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("group"), (F.col("count") * F.col(v) / 100).alias("weight")) for k, v in categories.items()]))
        super().__init__(data.select(F.col("name").alias("value"), each.alias("e")).select("value", "e.group", "e.weight"), on=on)
        self.categories = dict(categories)


class Name(Rule):
    """A first or last name by frequency, from a pool {name: weight}; without one, of the optional Faker library."""

    def __init__(self, which: str = "first_name", pool: Mapping[str, float] | None = None):
        if which not in NAME_POOLS:
            raise ValueError(f"which must be one of {tuple(NAME_POOLS)}, got {which!r}")
        self.which = which
        self.pool = checked_pool(pool, NAME_POOLS[which]) if pool is not None else _faker_pool(NAME_POOLS[which])

    def spark_type(self) -> str | None:
        return "string"

    def column(self, key, seed, salt, env):
        return derive.pick(key, seed, salt, list(self.pool), list(self.pool.values()), "string")

    def attach(self, df, name, key, seed, salt):
        if len(self.pool) <= derive.CASE_VALUES:
            return super().attach(df, name, key, seed, salt)
        frame = df.sparkSession.createDataFrame(list(self.pool.items()), "value string, weight double")
        return PoolChoice(frame).attach(df, name, key, seed, salt)


def checked_pool(pool: Any, what: str) -> dict[str, float]:
    """A pool of names with positive finite weights, as it must be for picks by frequency."""
    if not isinstance(pool, Mapping) or not pool:
        raise RuntimeError(f"name pool {what} must be a mapping of names to weights, got {type(pool).__name__}")
    for name, weight in pool.items():
        if not isinstance(name, str):
            raise RuntimeError(f"name pool {what} has {name!r}, which is no name")
        if isinstance(weight, bool) or not isinstance(weight, numbers.Real) or not math.isfinite(weight) or weight <= 0:
            raise RuntimeError(f"name pool {what} has weight {weight!r} for {name!r}; weights must be positive numbers")
    return {k: float(v) for k, v in pool.items()}


def _faker_pool(attribute: str) -> dict[str, float]:
    try:
        from faker.providers.person.en_US import Provider
    except ImportError:
        raise RuntimeError("names need a pool, or the Faker library, which is not installed") from None
    return checked_pool(getattr(Provider, attribute, None), attribute)


class SSN(Rule):
    """Numbers formed like social security numbers: area 1 to 899 but 666, group 1 to 99, serial 1 to 9999."""

    def spark_type(self) -> str | None:
        return "string"

    def column(self, key, seed, salt, env):
        area = derive.integers(key, seed, f"{salt}\0area", 1, 899)
        area = F.when(area >= 666, area + 1).otherwise(area)
        group, serial = derive.integers(key, seed, f"{salt}\0group", 1, 100), derive.integers(key, seed, f"{salt}\0serial", 1, 10_000)
        return F.format_string("%03d-%02d-%04d", area, group, serial)
