"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from derivia.llm import substring_dedup, suffix_dedup
from derivia.llm.repeats import key_table
from derivia.llm.substring_dedup import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_words(docs, length):
    words = {d: WORD.findall(t or "") for d, t in docs}
    counts = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out[d] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
    return out


def by_bytes(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        gone = gone[: len(b)]
        out[d] = len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]][: len(b)]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(0, None), (1, ""), (2, " \n "), (3, "a" * 500), (4, "ab " * 200), (5, "a" * 300 + "b"), (6, "é" * 120), (7, "é" * 120)]
    base, line = text(300), text(50)
    for i in range(8, 40):
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary)]
        docs.append((i, " ".join(w)))
    return docs + [(i, f"{text(20)}\n{line}\n{text(20)}") for i in range(40, 70)]


OPTIONS = [{}, {"crowd": 3}, {"most_kinds": 3}]


@pytest.mark.parametrize("options", OPTIONS)
def test_words(spark, options):
    docs = documents()
    got = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), **options, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == by_words(docs, 35)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("options", OPTIONS)
def test_bytes(spark, options):
    docs = documents()
    got = suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == by_bytes(docs, 100)


OPERATORS = [substring_dedup, suffix_dedup]


@pytest.mark.parametrize("op", OPERATORS)
def test_empty_table(spark, op):
    assert op.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("op", OPERATORS)
def test_null_ids_and_repeated_rows(spark, op):
    text = " ".join(f"x{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text, 0, 5), (1, text, 0, 5), (None, text, 0, 5)], "doc_id long, text string, id int, n_removed int")
    assert [r.n_removed for r in op.deduplicated(rows).collect()] == [0, 0, 0]


@pytest.mark.parametrize("op", OPERATORS)
def test_rows_that_share_an_id_but_not_a_text(spark, op):
    text = " ".join(f"x{i}" for i in range(80))
    alone = " ".join(f"y{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text), (2, text), (2, alone)], "doc_id long, text string")
    got = {(r.doc_id, r.kept_text): r.n_removed for r in op.deduplicated(rows, with_text=True).collect()}
    assert got[2, alone] == 0
    assert got[2, ""] > 0
    assert len(got) == 3
    assert got[1, "" if op is substring_dedup else text] == (80 if op is substring_dedup else 0)


@pytest.mark.parametrize("op", OPERATORS)
def test_ids_of_text(spark, op):
    text = " ".join(f"x{i}" for i in range(80))
    rows = spark.createDataFrame([("b", text), ("a", text), ("c", "z"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r.n_removed > 0 for r in op.deduplicated(rows).collect()}
    assert got == {"a": op is substring_dedup, "b": True, "c": False, None: False}


def test_columns_come_in_the_order_of_the_contract(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert substring_dedup.deduplicated(rows).columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert suffix_dedup.deduplicated(rows).columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_key_table_holds_its_keys_whatever_its_size(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(k),) for k in keys[:2500].view(np.int64)], "key long")
    for bits in (10, 28):
        table = key_table(frame, 2500, most_bits=bits)
        assert table.bits <= bits
        assert table.has(keys[:2500]).all()
    assert table.has(keys[2500:]).mean() < 0.2


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 70))])
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_automaton_counts_and_matches():
    a = SuffixAutomaton()
    a.add(list("abcbc"))
    a.add(list("cbx"))
    a.close()
    got = list(a.matching(list("zbcbx"), 2))
    assert got == [(0, 0), (1, 3), (2, 2), (2, 2), (2, 1)]
