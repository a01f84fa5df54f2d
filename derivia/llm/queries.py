"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.llm import cross_polytope, dart_minhash, license_scan, mixing, piece_codec, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filters
from derivia.llm._common import table, word_count


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def spread(docs: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt to all of them; others as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


#: Entries of the dated list that hold for whole domains.
DOMAIN_ENTRIES = (("example.net", "block", "2024-06-01"), ("example.net", "remove", "2024-09-01"), ("example.org", "block", "2024-10-15"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures; the table has no fetch time, so each page gets a day of 2024 from its id."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of the pages: some blocked from a day on, some of them for 60 days, some paths let through."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).filter("host is not null").distinct().withColumn("h", F.md5("host"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring("h", 2, 2), 16, 10).cast("int"))
    digit = F.substring("h", 1, 1)
    blocked = hosts.filter(digit < "5").select(F.col("host").alias("key"), F.lit("block").alias("action"), day.alias("listed_at"))
    ended = hosts.filter(digit < "2").select(F.col("host").alias("key"), F.lit("remove").alias("action"), F.date_add(day, 60).alias("listed_at"))
    passed = hosts.filter(F.substring("h", 4, 1) < "8").select(F.concat("host", F.lit("/en")).alias("key"), F.lit("allow").alias("action"), F.lit("2024-03-01").cast("date").alias("listed_at"))
    fixed = pages.sparkSession.sql("SELECT key, action, cast(day AS date) AS listed_at FROM VALUES " + ", ".join(map(str, DOMAIN_ENTRIES)) + " AS t(key, action, day)")
    return blocked.union(ended).union(passed).union(fixed)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filtered(captures(spark, sf_dir), list_entries(table(spark, sf_dir, "pages")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_documents(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    out = mixing.mix(docs, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.coded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_file("piece_bpe_32k.model"))


def op10_quality_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.judged(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_source_mix": op5_source_mix,
    "op6_section_tokens": op6_section_tokens,
    "op7_license_scan": op7_license_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_piece_codec": op9_piece_codec,
    "op10_quality_list": op10_quality_list,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH pages_ AS (
  SELECT page_id, (DATE '2024-01-01' + ((page_id * 7919) % 366)::INT)::DATE AS fetched_at,
    rtrim(lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1), '')), '.') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS path
  FROM pages
), keyed AS (
  SELECT page_id, fetched_at, host, unnest(list_concat(
    list_transform(range(1, CASE WHEN regexp_matches(host, '^([0-9.]+$|\[)') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')))) AS key
  FROM pages_ WHERE host IS NOT NULL
), hosts AS (
  SELECT host, md5(host) AS h, (DATE '2024-01-01' + ('0x' || substr(md5(host), 2, 2))::INT)::DATE AS day FROM (SELECT DISTINCT host FROM pages_ WHERE host IS NOT NULL)
), entries AS (
  SELECT host AS key, 'block' AS action, day AS listed_at FROM hosts WHERE substr(h, 1, 1) < '5'
  UNION ALL SELECT host, 'remove', (day + 60)::DATE FROM hosts WHERE substr(h, 1, 1) < '2'
  UNION ALL SELECT host || '/en', 'allow', DATE '2024-03-01' FROM hosts WHERE substr(h, 4, 1) < '8'
  UNION ALL VALUES ('example.net', 'block', DATE '2024-06-01'), ('example.net', 'remove', DATE '2024-09-01'), ('example.org', 'block', DATE '2024-10-15')
), spans AS (
  SELECT key, action, listed_at AS active_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS active_to
  FROM (SELECT key, listed_at, max(action) AS action FROM entries GROUP BY key, listed_at)
), met AS (
  SELECT k.page_id, s.key AS rule, s.action, s.active_from, row_number() OVER (PARTITION BY k.page_id ORDER BY length(s.key) DESC, s.key DESC) AS n
  FROM keyed k JOIN spans s ON k.key = s.key AND s.action <> 'remove' AND s.active_from <= k.fetched_at AND (s.active_to IS NULL OR k.fetched_at < s.active_to)
)
SELECT p.page_id, p.host, p.fetched_at, coalesce(m.action = 'block', FALSE) AS blocked, m.rule, m.active_from
FROM pages_ p LEFT JOIN met m ON p.page_id = m.page_id AND m.n = 1
""",
    "op5_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || doc_id) AS k FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * sum(size)::DOUBLE AS cap
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER p, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0.0::DOUBLE)) AS level
  FROM sources WINDOW p AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM levels
), ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    round(t.target)::BIGINT AS budget, CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM ordered
""",
}
