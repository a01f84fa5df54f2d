"""MinHash and embedding near-dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from derivia.llm import cross_polytope, dart_minhash
from derivia.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("alone", [0, 1000])
def test_components(spark, alone):
    links = [(9, 3), (3, 7), (1, 2), (2, 2), (2, 1), *[(i, i + 1) for i in range(20, 60)]]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), alone=alone).collect()}
    assert got == {9: 3, 3: 3, 7: 3, 1: 1, 2: 1, **dict.fromkeys(range(20, 61), 20)}
    assert components(spark.createDataFrame([], "a long, b long"), alone=alone).count() == 0


def documents():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(0, None), (1, ""), (2, "a"), (3, "a"), (4, " \n"), (5, "a b c")]
    for g in range(3):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(80 if g == 0 else 15):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[(k := rng.randrange(len(w))) : k + 1] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            docs.append((len(docs), " ".join(w)))
    line = [rng.choice(vocabulary) for _ in range(12)]
    return docs + [(len(docs) + i, " ".join(line * times)) for i, times in enumerate((1, 2, 4, 8, 9, 10, 40, 44))]  # of equal windows, more and fewer times


@pytest.mark.parametrize("options", [{}, {"rounds": 0, "block": 16}])
def test_near_documents(spark, options):
    docs = documents()
    sets = []
    for _, t in docs:
        w = WORD.findall(t or "")
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    want = classes(len(docs), [(j, i) for i in range(len(docs)) for j in range(i) if sets[i] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()])
    got = dart_minhash.near_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), **options).collect()
    assert [r.class_id for r in sorted(got)] == want and all(r.kept == (r.class_id == r.doc_id) for r in got)


def test_near_documents_edges(spark):
    assert dart_minhash.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, dart_minhash.near_documents(rows).collect()), key=repr) == [(1, 1, True), (1, 1, True), (None, None, True)]


def test_near_documents_of_shared_ids_and_other_types(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([("b", text, 1), ("b", text, 1), ("b", "something else", 1), ("a", text + " x", 1), ("c", None, 1), (None, text, 1), ("d", "z " * 50_000, 1)], "doc_id string, text string, id int")
    got = dart_minhash.near_documents(rows).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "a", True), ("b", "a", False), ("b", "a", False), ("b", "b", True), ("c", "c", True), ("d", "d", True), (None, None, True)], key=repr)


def test_expanded_sets_have_the_weighted_similarity():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (Counter(rng.integers(0, 6, rng.integers(0, 20)).tolist()) for _ in range(2))
        plain = [set(dart_minhash.expanded(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.int64), np.array([0, len(c)]))[0].tolist()) for c in (a, b)]
        assert (len(plain[0] & plain[1]), len(plain[0] | plain[1])) == ((a & b).total(), (a | b).total())


def test_signatures_estimate_weighted_similarity():
    x, w, v = np.arange(1, 5, dtype=np.uint64) * np.uint64(1 << 40), np.array([1.0, 3, 0.5, 7]), np.array([2.0, 1, 0.5, 7])
    same = [np.mean(np.equal(*dart_minhash.signatures(np.r_[x, x], np.r_[w, v], np.array([0, 4, 8]), 64, seed))) for seed in range(150)]
    assert abs(np.mean(same) - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.02


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        b = rng.normal(size=64)
        b /= np.linalg.norm(b)
        for _ in range(90 if i == 0 else rng.integers(1, 6)):
            c, v = rng.uniform(0.92, 0.995), rng.normal(size=64)
            v -= v @ b * b
            rows.append((c * b + np.sqrt(1 - c * c) * v / np.linalg.norm(v)).tolist())
    n = len(rows)
    rows += [rows[3]] * 5 + [[0.0] * 64, None, [float("nan")] * 64, [], [1.0] * 3, [2.0] * 3, [2 * x for x in rows[5]], [1.0, None]]
    got = {r.vec_id: r for r in cross_polytope.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    ok = [i for i, v in enumerate(rows) if v is not None and len(v) == 64 and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i] for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    counts, found = linked.sum(1), np.array([got[i].n_links for i in ok])
    assert (found <= counts).all() and found.sum() >= 0.97 * counts.sum()
    assert (got[n + 9].n_links, got[n + 10].component_id) == (1, n + 9)
    assert all(got[i].n_links == 0 and got[i].kept for i in (n + 5, n + 6, n + 7, n + 8, n + 12))
    assert got[n].component_id == got[3].component_id and got[3].n_links >= 5


def test_near_vectors_edges(spark):
    assert cross_polytope.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, cross_polytope.near_vectors(rows).collect()), key=repr) == [(4, 0, 4, True), (None, 0, None, True)]


@pytest.mark.parametrize(("dims", "vectors"), [(64, 4000), (24, 1500)])
def test_near_vectors_recall_by_band(spark, dims, vectors):
    """Pairs at a cosine just above the threshold are found as others are; queries are the ids divisible by 20, against all rows."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(vectors // 2, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = rng.normal(size=base.shape)
    v -= (v * base).sum(1, keepdims=True) * base
    c = rng.uniform(0.94, 0.999, (len(base), 1))
    x = np.concatenate((base, c * base + np.sqrt(1 - c * c) * v / np.linalg.norm(v, axis=1, keepdims=True))).astype(np.float32)
    order = rng.permutation(len(x))
    x = x[order]
    rows = [(i, r.tolist(), 1, 2.0, "z") for i, r in enumerate(x)]
    got = cross_polytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, v double, key string")).collect()
    links = {r.vec_id: r.n_links for r in got}
    assert len(links) == len(rows)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    found, there = {}, {}
    for q in range(0, len(y), 20):
        cosine = y @ y[q]
        near = [float(z) for i, z in enumerate(cosine) if z >= 0.95 and i != q]
        assert links[q] <= len(near)
        if len(near) == 1:
            band = int(near[0] * 100)
            there[band] = there.get(band, 0) + 1
            found[band] = found.get(band, 0) + links[q]
    assert len(there) >= 4 and all(found[b] >= 0.9 * there[b] for b in there)


def test_plan_keeps_buckets_apart_as_the_table_grows():
    for width in (64, 384):
        for count in (0, 1, 10**4, 10**6, 10**9, 10**11):
            hashes, tables = cross_polytope.plan(count, width)
            assert (2 * width) ** hashes >= 128 * count and tables <= 60
