"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from derivia.llm._common import arrow_setup, checkpointed, mixed
from derivia.llm.components import components, spanning

#: Buckets that a vector is put in for each table.
PROBES = 4
#: Vectors of a bucket that one task compares with as many others; larger buckets are compared block by block.
BLOCK = 1024
#: Rows that a task compares together, and numbers in a product of many small buckets.
ROWS, NUMBERS = 8192, 1 << 22


def plan(count: int, width: int) -> tuple[int, int]:
    """Hashes in a table, and tables, for so many vectors of so many numbers.

    There are 128 times as many buckets as vectors or more, so that the unlike pairs of a bucket grow with the vectors
    and not with their square, and half as many tables again for each further hash, which keeps the recall.
    """
    hashes = max(4, math.ceil(math.log(128 * max(count, 1)) / math.log(2 * max(width, 2))))
    return hashes, math.ceil(6 * 1.5 ** (hashes - 3))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform of the columns, whose height is a power of two.

    Sums and differences of single numbers only, so a column's result does not depend on the others.
    """
    d, n = x.shape
    x = x.copy()
    for k in range(3):
        signs = np.where(mixed(np.arange(d, dtype=np.uint64) + np.uint64(seed * 3 + k << 32)) & np.uint64(1), 1.0, -1.0)
        x *= (signs / np.sqrt(d)).astype(x.dtype)[:, None]
        h = 1
        while h < d:
            halves = x.reshape(d // (2 * h), 2, h, n)
            total = halves[:, 0] + halves[:, 1]
            np.subtract(halves[:, 0], halves[:, 1], out=halves[:, 1])
            halves[:, 0] = total
            h *= 2
    return x


def buckets(x: np.ndarray, hashes: int, tables: int, probes: int = PROBES, seed: int = 0) -> np.ndarray:
    """Bucket keys, n x tables x probes, of unit rows; the first probe is the row's own bucket.

    A hash is the closest of the 2 d signed axes after a rotation. The other probes replace one hash, or two, by its
    second closest axis, those first that lose least.
    """
    n, d = x.shape
    width = 1 << max(1, math.ceil(math.log2(max(d, 2))))
    x = np.ascontiguousarray(np.pad(x, ((0, 0), (0, width - d))).T, np.float32)
    out = np.empty((n, tables, probes), np.uint64)
    cols = np.arange(n)
    choices = [(k,) for k in range(hashes)] + [(a, b) for a in range(hashes) for b in range(a)]
    for t in range(tables):
        codes, seconds, gaps = [], [], []
        for k in range(hashes):
            r = rotated(x, seed * 1_000_003 + t * hashes + k + 1)
            size = np.abs(r)
            first = size.argmax(0)
            top = size[first, cols]
            size[first, cols] = -1
            second = size.argmax(0)
            codes.append((2 * first + (r[first, cols] < 0)).astype(np.uint64))
            seconds.append((2 * second + (r[second, cols] < 0)).astype(np.uint64))
            gaps.append(top - size[second, cols])
        loss = np.stack([sum(gaps[k] for k in c) for c in choices], 1)
        order = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        for p in range(probes):
            key = np.full(n, t + 1, np.uint64)
            for k in range(hashes):
                swap = np.array([k in c for c in choices])[order[:, p - 1]] if p else False
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.where(swap, seconds[k], codes[k]))
            out[:, t, p] = key
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, as squares of very large or small numbers are none."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit matrix of the vectors of each length."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        own = vectors if len(rows) == len(size) else vectors.take(pa.array(rows))
        yield rows, _unit(own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def linked_pairs(x: np.ndarray, y: np.ndarray, keys_x: np.ndarray, keys_y: np.ndarray, here: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two blocks of bucket `here`, each only in the first bucket that both share."""
    linked = x @ y.T >= least
    if same:
        linked &= np.tri(len(x), len(y), -1, dtype=bool).T
    earlier = np.intersect1d(keys_x[keys_x < here], keys_y[keys_y < here])
    for lo in range(0, len(earlier), 2048):
        if not linked.any():
            break
        part = earlier[lo : lo + 2048]
        linked &= _incidence(keys_x, part) @ _incidence(keys_y, part).T < 0.5
    return np.nonzero(linked)


def _incidence(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which rows have which of the sorted keys."""
    at = np.minimum(np.searchsorted(part, keys), len(part) - 1)
    rows, cols = np.nonzero(part[at] == keys)
    out = np.zeros((len(keys), len(part)), np.float32)
    out[rows, at[rows, cols]] = 1
    return out


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, seed: int = 0) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors are linked if their cosine in double precision is `least` or more and they share a bucket. n_links is
    the number of other vectors linked directly, component_id the smallest id reachable by links, kept whether that is
    its own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors
    of different lengths and vectors without an id. Rows of one id count each; ids should be distinct. An empty table gives an empty one.

    Equal vectors become one class with a count before anything is hashed, so copies are never paired. A bucket of
    more than a block of classes is compared block by block, every block pair in a task of its own, and a pair counts
    in the first bucket that both share only; tasks return sums and a spanning set of links, not the pairs. A class
    goes to its buckets with the keys of all of them that have company, at most tables times probes.
    """
    spark = vectors.sparkSession
    arrow_setup(spark)
    v, kind = F.col("v"), vectors.schema[vector_col].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    finite = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    base = base.withColumn("v", F.when(finite & F.col("id").isNotNull(), F.transform(v, lambda e: e + F.lit(0).cast(element))))
    classes = checkpointed(base.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    count, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    hashes, tables = plan(count, width or 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_width(batch.column("v")) if len(batch) else ():
                one = np.sort(buckets(x, hashes, tables, seed=seed).reshape(len(x), -1).view(np.int64), 1)
                fresh = np.c_[np.ones(len(x), bool), one[:, 1:] != one[:, :-1]]
                reps = batch.column("rep").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([pa.array(one[fresh]), pa.array(np.repeat(reps, fresh.sum(1)))], ["key", "rep"])

    placed = classes.select("v", "rep").mapInArrow(hashed, "key long, rep long")
    sizes = placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    live = placed.join(sizes, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "size")).alias("live"))
    met = classes.join(live, "rep").select("rep", "n", "v", F.array_sort(F.col("live.key")).alias("keys"), F.explode("live").alias("here"))
    met = met.withColumn("blocks", F.ceil(F.col("here.size") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Every block meets every block once: row (i, j) with i <= j holds both blocks' vectors.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.col("here.key").alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "v", "keys")
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                marks = np.stack([whole.column(c).to_numpy() for c in ("key", "i", "j")], 1)
                cut = int(np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)])[-1])  # where the last, open block pair starts
                if cut:
                    yield compared_rows(whole.slice(0, cut), least)
                held = [whole.slice(cut)]
        if sum(map(len, held)):
            yield compared_rows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], least)

    found = checkpointed(dealt.mapInArrow(compared, "id long, links long, other long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    parts = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    known = classes.join(counts, "rep", "left").join(parts, "rep", "left").select("v", F.col("n"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = base.alias("b").join(known.alias("k"), F.col("b.v") == F.col("k.v"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _with_pairs(x: np.ndarray, starts: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which runs of `size` rows, many at a time, hold a linked pair."""
    upper = np.triu(np.ones((size, size), bool), 1)
    out = np.zeros(len(starts), bool)
    step = max(1, NUMBERS // (size * x.shape[1]))
    for lo in range(0, len(starts), step):
        part = x[starts[lo : lo + step, None] + np.arange(size)]
        out[lo : lo + step] = ((part @ part.transpose(0, 2, 1) >= least) & upper).any((1, 2))
    return out


def compared_rows(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """id, links, other: sums of links (other null) and spanning links (links 0) of whole block pairs, sorted by key, i, j."""
    key, i, j, block, rep, n = (batch.column(c).to_numpy() for c in ("key", "i", "j", "block", "rep", "n"))
    lists = batch.column("keys")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keys = np.full((len(batch), int(size.max())), np.iinfo(np.int64).max)
    keys[np.arange(keys.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    ids, sums, a_s, b_s = [], [], [], []
    for rows, x in _by_width(batch.column("v")):
        k, i_, j_ = key[rows], i[rows], j[rows]
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i_[1:] != i_[:-1]) | (j_[1:] != j_[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        alone = i_[starts] == j_[starts]
        open_ = sizes > 1
        for m in np.unique(sizes[open_ & alone & (sizes <= 64)]).tolist():
            these = np.flatnonzero(open_ & alone & (sizes == m))
            open_[these] = _with_pairs(x, starts[these], m, least)
        for g in np.flatnonzero(open_).tolist():
            lo, hi = int(starts[g]), int(starts[g] + sizes[g])
            at = np.arange(lo, hi)
            left = block[rows[at]] == i_[lo]
            p, q = (at, at) if alone[g] else (at[left], at[~left])
            if not len(p) or not len(q):
                continue
            a, b = linked_pairs(x[p], x[q], keys[rows[p]], keys[rows[q]], int(k[lo]), least, bool(alone[g]))
            a, b = rows[p[a]], rows[q[b]]
            if len(a):
                ids += [rep[a], rep[b]]
                sums += [n[b], n[a]]
                links = spanning(rep[a], rep[b])
                a_s += [x for x, _ in links]
                b_s += [y for _, y in links]
    ids, sums = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ids, sums))
    linked, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(linked), np.int64)
    np.add.at(total, at, sums)
    other = pa.array([None] * len(linked) + b_s, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.r_[linked, np.array(a_s, np.int64)]), pa.array(np.r_[total, np.zeros(len(a_s), np.int64)]), other], ["id", "links", "other"])
