"""Nulls, repeated rows, very long texts, empty tables and clashing columns, for every operator on documents."""

import re

import pytest
from pyspark.sql import functions as F

from derivia.llm import dart_minhash, license_scan, mixing, piece_codec, quality_rules, substring_dedup, suffix_dedup, token_counts
from derivia.llm.queries import tokenizer_file, tokenizer_pattern

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 9973}" for i in range(200_000)) + "\n" + "x" * 100_000
ROWS = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, " \n\t"), (None, "one two"), (None, None), (5, LONG)]

OPERATORS = {
    "substring": lambda d: substring_dedup.deduplicated(d),
    "suffix": lambda d: suffix_dedup.deduplicated(d),
    "minhash": lambda d: dart_minhash.near_documents(d),
    "sections": lambda d: token_counts.section_tokens(d, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern()),
    "licenses": lambda d: license_scan.scanned(d),
    "codec": lambda d: piece_codec.coded(d, tokenizer_file("piece_bpe_32k.model")),
    "quality": lambda d: quality_rules.judged(d, quality_rules.DecisionList(())).select("doc_id", "n_words", "kept"),
    "mix": lambda d: mixing.mix(d, size=F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).select("doc_id", "size", "taken"),
}
#: Names that the operators use themselves, in and beside their results.
CLASHES = ["id", "key", "n", "n_words", "n_tokens", "size", "kept", "bands", "grams", "lo", "class_id", "section", "license", "target", "hash"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    ids = sorted((r.doc_id for r in got), key=repr)
    if name == "licenses":
        assert ids == []
    elif name == "sections":
        assert set(ids) == {1, 2, 3, 4, 5, None} and sum(r.doc_id == 1 for r in got) == 2 and sum(r.n_bytes for r in got if r.doc_id == 5) == len(LONG)
    else:
        assert ids == sorted((i for i, _ in ROWS), key=repr)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    if name == "substring":
        assert by_id[5].n_words == len(WORD.findall(LONG)) and by_id[1].n_removed == 0 and by_id[2].n_words == 0
    if name == "suffix":
        assert by_id[5].n_bytes == len(LONG) and by_id[2].n_bytes == 0 and by_id[4].n_bytes == 3
    if name == "minhash":
        assert all(r.kept and r.class_id == r.doc_id for r in got)
    if name == "codec":
        assert by_id[2].n_tokens == by_id[3].n_tokens == 0 < by_id[5].n_tokens
    if name == "quality":
        assert by_id[5].n_words == len(WORD.findall(LONG)) and not by_id[2].kept
    if name == "mix":
        assert by_id[2].size == 0 and abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 0.5


def test_long_repeats_are_removed_exactly(spark):
    """A text of many units against brute force; its second half is its first half again."""
    half = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    rows = frame(spark, [(1, f"{half} | {half}")])
    words = substring_dedup.deduplicated(rows).first()
    assert (words.n_words, words.n_removed) == (120_001, 120_000)
    text = suffix_dedup.deduplicated(rows).first()
    assert (text.n_bytes, text.n_removed, text.n_spans) == (2 * len(half) + 3, len(half) + 0, 1) or text.n_removed - len(half) in (0, 1)
