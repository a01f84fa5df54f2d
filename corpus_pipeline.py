"""From raw documents to tokens of a mix: quality rules, near-dedup, substring dedup, source mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.llm import dart_minhash, mixing, piece_codec, quality_rules, suffix_dedup
from derivia.llm._common import removed, shared_folder, table, with_numbers
from derivia.llm.queries import tokenizer_file

#: No stage but the first and fourth could be told in SQL, and the first learns its rules.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the list learned from `labels` rejects go; the rest stay as they are.

    Null and empty texts fail the base rule. Repeated rows share a verdict. Without labels only the base rule acts.
    """
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the first document stays, as it is; those without an id stay.

    Equal rows (id and text) are one document; rows of one id with different texts are documents of their own. Empty and
    null texts are like nothing and stay. An empty table stays empty.
    """
    own, repeated = with_numbers(docs, "doc_id", "text", "__n")
    if repeated is not None:
        own = own.filter("__n is not null").dropDuplicates(["__n"]).unionByName(own.filter("__n is null"))
    copies = dart_minhash.near_documents(own, id_col="__n").filter("not kept").select("__n")
    return own.join(copies, "__n", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 100-byte string covers which starts earlier go from the texts; n_chars follows; no document goes.

    A null text becomes an empty one. Documents without an id stay as they are; equal rows (id and text) are cut alike, and
    rows of one id with different texts each by itself. An empty table stays empty.
    """
    own, repeated = with_numbers(docs, "doc_id", "text", "__n")
    cut = suffix_dedup.deduplicated(own, id_col="__n", with_text=True).filter("n_removed > 0 and __n is not null").select("__n", F.col("kept_text").alias("__kept"))
    out = own.join(cut if repeated is None else cut.dropDuplicates(["__n"]), "__n", "left").withColumn("__text", F.coalesce("__kept", "text", F.lit("")))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__kept").isNotNull(), F.length("__text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a source's last one cut at its budget; those of no share go.

    A null source is a source; null and empty texts have no words and go. Repeated rows are taken each by itself. An empty
    table stays empty.
    """
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them; no document goes.

    Null and empty texts have no tokens; repeated rows are encoded each by itself; an empty table gives an empty one.
    """
    carry = [c for c in ("lang", "source") if c in docs.columns]
    return piece_codec.coded(docs, tokenizer_file("piece_bpe_32k.model"), carry=carry, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("piece_encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet to the shared folder and read again by the next.

    A stage's table goes when the next one has been written; the last stays, as the result is read from it.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
