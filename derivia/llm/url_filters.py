"""URL filters as a temporal list join: every capture meets the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of equal captures that one array holds.
RUN = 10_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, an IPv6 address in its brackets; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def keys_of(url: Column) -> Column:
    """What list entries a URL can meet: its host, the domains above it of two labels at least, and all host/path prefixes.

    An address is under no domain.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    above = F.when(host.rlike(r"^([0-9.]+$|\[)"), F.lit(0)).otherwise(n - 2)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(above + 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), "/"), lambda x: x != "")
    prefixes = F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/"))))
    return F.when(host.isNotNull(), F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (key, action, listed_at) as validity intervals (key, action, active_from, active_to).

    An entry holds until the next one of its key; action `remove` ends it. Of entries of one key and moment the last
    by action counts. Entries with a null key, action or moment are left out. A key's entries meet in one task, the
    captures of a key never do.
    """
    dated = entries.filter(F.col("key").isNotNull() & F.col("action").isNotNull() & F.col("listed_at").isNotNull())
    one = dated.groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    ends = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    spans = one.select("key", "action", F.col("listed_at").alias("active_from"), ends.alias("active_to"))
    return spans.filter(F.col("action") != "remove")


def filtered(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, host, fetch time, blocked, rule, active_from.

    The entry of the longest key that was active at the fetch time decides: `block` blocks, any other action lets the
    capture pass. Without such an entry, host or fetch time it passes and rule is null. Repeated captures and those
    without an id have a row each: equal ones are judged once and come out as often as they went in. The join is an equi-join on the key with the interval as a condition: at most
    one interval of a key holds at a time, so it makes no more rows than captures have keys, and the engine may
    broadcast the list where its size is known to be small or split a hot host's captures. An empty table gives an empty
    one, an empty list lets all pass. Captures of other columns, whatever their names, do not matter; a URL may be of any
    length, and has as many keys as segments.
    """
    base = captures.select(F.col(id_col).alias("__id"), F.col(time_col).alias("__at"), F.col(url_col).alias("__url"))
    keyed = base.select("__id", "__at", "__url", host_of(F.col("__url")).alias("host"), F.posexplode_outer(keys_of(F.col("__url"))).alias("__pos", "__key"))
    spans = validity(entries)
    active = (F.col("__key") == F.col("key")) & (F.col("active_from") <= F.col("__at")) & (F.col("active_to").isNull() | (F.col("__at") < F.col("active_to")))
    met = keyed.join(spans, active, "left")
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("action").alias("action"), F.col("active_from").alias("active_from")))).alias("best")
    times = F.count_if(F.coalesce("__pos", F.lit(0)) == 0).alias("times")
    out = met.groupBy("__id", "__at", "__url", "host").agg(best, times)
    out = out.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / RUN).cast("int"))))
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("times") - F.col("__run").cast("long") * RUN).cast("int"))))
    return out.select(
        F.col("__id").alias(id_col), "host", F.col("__at").alias(time_col),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.key").alias("rule"), F.col("best.active_from").alias("active_from"),
    )
