"""MinHash near-dedup with DartMinHash signatures, banded joining and verified links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import arrow_setup, checkpointed, checkpointed_by, chunks, flat_bytes, flat_words, mixed, numbered, renamed, span_hashes
from derivia.llm.components import components, spanning
from derivia.llm.repeats import TABLE_BITS, key_table

WORDS = 5
#: 25 bands of 5 coordinates: a pair of similarity 0.8 shares a band with probability 0.99995, one of 0.3 with 0.06.
BANDS, ROWS = 25, 5
#: Lower ends of the dart ranks' slabs: 0, then powers of two.
FIRST_SLAB = -6
#: Rounds in which each member meets one other before all that are still apart meet.
ROUNDS = 3
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the number of darts in a region of this area."""
    most = int(area + 12 * np.sqrt(area) + 24)
    k = np.arange(1, most + 1)
    logs = np.r_[0.0, np.cumsum(np.log(area) - np.log(k))] - area
    return np.cumsum(np.exp(logs))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def darts(x: np.ndarray, weight: np.ndarray, reach: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts that hit each element below its weight and with ranks below its reach: element's place, rank, dart id.

    Darts are a unit-rate random scatter over (element, weight axis, rank axis), fixed by hashes: each dyadic cell of
    the two axes holds a Poisson number of darts at hashed places, so equal elements of different sets have the same
    ones and a heavier element has more.
    """
    places, ranks, ids = [], [], []
    level, heavy = 0, np.flatnonzero(weight > 0)
    while len(heavy):
        w_lo, w_hi = (0.0 if level == 0 else 2.0 ** (level - 1)), 2.0**level
        partly = weight[heavy] < w_hi
        slab, r_hi = 0, 0.0
        while reach[heavy].max() > r_hi:
            r_lo, r_hi = r_hi, 2.0 ** (FIRST_SLAB + slab)
            at = heavy[reach[heavy] > r_lo]
            cell = mixed(x[at] * _K1 + np.uint64(((seed << 20) + (slab << 8) + level + 1) * int(_K2) & 0xFFFFFFFFFFFFFFFF))
            n = np.searchsorted(_poisson((r_hi - r_lo) * (w_hi - w_lo)), _uniform(cell), "right")
            hit = np.repeat(np.arange(len(at)), n)
            if len(hit):
                number = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
                dart = mixed(cell[hit] + (number.astype(np.uint64) + np.uint64(1)) * _K3)
                rank = r_lo + (r_hi - r_lo) * _uniform(mixed(dart + _K2))
                keep = rank <= reach[at[hit]]
                if partly.any():
                    keep &= w_lo + (w_hi - w_lo) * _uniform(mixed(dart + _K3)) < weight[at[hit]]
                places.append(at[hit[keep]])
                ranks.append(rank[keep])
                ids.append(dart[keep])
            slab += 1
        level, heavy = level + 1, heavy[weight[heavy] > w_hi]
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(ranks or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0, np.uint64)])


def signatures(x: np.ndarray, weight: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k coordinates for each weighted set: the id of its earliest dart there. Sets without weight get zeros."""
    sets = len(offsets) - 1
    total = np.add.reduceat(np.r_[weight, 0.0], offsets[:-1]) if sets else np.zeros(0)
    total[offsets[1:] == offsets[:-1]] = 0
    out = np.zeros((sets, k), np.uint64)
    # About k ln k + 2 k darts leave no coordinate empty, mostly; for the rest the reach doubles.
    reach = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(sets), where=total > 0)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    open_ = total > 0
    while open_.any():
        part = np.flatnonzero(open_[owner])
        place, rank, dart = darts(x[part], weight[part], reach[owner[part]], seed)
        key = owner[part[place]] * k + (mixed(dart + _K1) % np.uint64(k)).astype(np.int64)
        first = np.full(sets * k, np.inf)
        np.minimum.at(first, key, rank)
        won = rank == first[key]
        flat = out.reshape(-1)
        flat[key[won]] = dart[won]
        open_ &= np.isinf(first.reshape(sets, k)).any(1)
        reach[open_] *= 2
    return out


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word windows of each text, how often each is there, and the texts' offsets into both.

    A text of fewer words has one window of all of them, an empty one none.
    """
    data, offsets = flat_bytes(texts)
    starts, ends, at = flat_words(data, offsets)
    h = span_hashes(data, starts, ends)
    n = len(h)
    whole = np.zeros(max(n - words + 1, 0), np.uint64)
    for i in range(words):
        whole = mixed(whole * _K1 + h[i : n - words + 1 + i]) if len(whole) else whole
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.sort(whole[a : b - words + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for i in range(a, b):
                x = mixed(x * _K1 + h[i : i + 1])
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
    all_ = np.concatenate(sets or [whole[:0]])
    ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    fresh = np.r_[True, all_[1:] != all_[:-1]][: len(all_)]
    fresh[ends[:-1][ends[:-1] < len(all_)]] = True
    first = np.flatnonzero(fresh)
    return all_[first], np.diff(np.r_[first, len(all_)]), np.searchsorted(first, ends)


def expanded(x: np.ndarray, times: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each weighted set as a plain one: of an element of weight k, the element itself and k - 1 more hashes.

    The weighted Jaccard similarity of two sets is the Jaccard similarity of their plain ones.
    """
    each, ends = np.repeat(x, times), np.r_[0, np.cumsum(times)]
    nth = np.arange(len(each)) - np.repeat(ends[:-1], times)
    more = nth > 0
    each[more] = mixed(each[more] + nth[more].astype(np.uint64) * _K3)
    return [np.sort(each[ends[a] : ends[b]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def banded(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, seed: int = 0) -> DataFrame:
    """id, digest of the windows and their numbers (null without words), and a key for each band of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x, times, offsets = shingles(batch.column("text"), words)
            sign = signatures(x, times.astype(np.float64), offsets, bands * rows, seed).reshape(len(batch), bands, rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _K2, (len(batch), 1))
            for r in range(rows):
                keys = mixed(keys * _K1 + sign[:, :, r])
            digest = [hashlib.blake2b(x[a:b].tobytes() + times[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))], ["id", "digest", "bands"])

    return docs.mapInArrow(run, "id long, digest binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, repeated: bool) -> DataFrame:
    """id, grams of the wanted ids, dealt by id, perhaps of some others too; `repeated`: ids may have several, equal rows.

    The texts are read where they are: a bit table of fixed size tells which are wanted. Where they are too many for it,
    the ids are joined.
    """
    spark, count = docs.sparkSession, wanted.count()
    if count <= 1 << (TABLE_BITS - 4):
        some = spark.sparkContext.broadcast(key_table(wanted.select(F.xxhash64("id").alias("key")), count))
        docs = docs.withColumn("key", F.xxhash64("id"))
    else:
        some, docs = None, docs.join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some is not None:
            batches = (b.filter(pa.array(some.value.has(b.column("key").to_numpy().view(np.uint64)))) for b in batches)
        for batch in chunks(batches):
            sets = expanded(*shingles(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "grams"])

    out = docs.filter("id is not null").mapInArrow(run, "id long, grams binary")
    return checkpointed_by(out.dropDuplicates(["id"]) if repeated else out, "id")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose windows have at least this similarity."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").filter(
        # Sets of too different sizes can't be that similar.
        F.least(F.length("x"), F.length("y")) >= least * F.greatest(F.length("x"), F.length("y"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                same = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(same >= least * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of slabs of their incidence matrix."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    grams = np.concatenate(sets)
    row = np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    fresh = np.r_[True, grams[1:] != grams[:-1]]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1  # a gram of one set adds to no intersection with another
    row, number = row[shared], np.cumsum((fresh & shared)[shared]) - 1
    for lo in range(0, int(number.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(number, (lo, lo + columns))
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], number[a:b] - lo] = 1
        out += part @ part.T
    np.fill_diagonal(out, list(map(len, sets)))
    return out


def _linked_blocks(rows: DataFrame, least: float) -> DataFrame:
    """Spanning links of the blocks (key, i, j), whose members' sets come together. Input: key, i, j, id, grams."""

    def work(batch: pa.RecordBatch) -> tuple[list[int], list[int]]:
        ids = batch.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("grams")]
        size = np.array(list(map(len, sets)), np.float64)
        same = overlaps(sets)
        a, b = np.nonzero(np.triu(same >= least * (size[:, None] + size[None, :] - same), 1))
        links = spanning(ids[a], ids[b])
        return [x for x, _ in links], [y for _, y in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in work(whole)], ["a", "b"])

        mark = None
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cuts = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(marks[lo]) != mark:
                    yield flush()
                mark = tuple(marks[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "id", "grams").mapInArrow(run, "a long, b long")


def near_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), kept (whether the document is its class's first).

    A class is a connected component of links: weighted Jaccard similarity of at least 0.8 of the five-word windows, each
    weighing as often as it is in the text. Documents of equal windows, copies among them, become one member before
    anything is paired; documents without words are alone, shorter ones have one window of all their words.

    Ids may be of any type that has an order; a null id has no class and is kept. Equal rows (id and text) are one
    document with a row each; rows of one id with different texts are documents of their own, though their class may be
    told by the same id. An empty table gives an empty one. A text is worked on in one task, in memory of about fifty times
    its size. Other columns, whatever their names, do not matter.

    Candidates share a band of their DartMinHash signatures. In each round every member of a bucket with several
    classes is verified against one other. Then, in buckets whose classes still differ, all members are, block by
    block, each block pair in a task of its own that returns a spanning set of its links; of buckets with the same
    members one is enough. A link inside a class changes nothing, so none that matters is lost. All state is tables
    in the checkpoint folder.
    """
    spark = docs.sparkSession
    arrow_setup(spark)
    base, numbers = numbered(docs, id_col, text_col)
    signed = checkpointed(banded(base, bands=bands, rows=rows, words=words, seed=seed))
    members = signed.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    placed = members.select("rep", F.explode("bands").alias("key"))
    crowded = placed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    met = checkpointed(placed.join(crowded, "key").select("key", F.col("rep").alias("id")))
    sets = _sets(base, met.select("id").distinct(), words, numbers is not None)
    links = spark.createDataFrame([], "a long, b long")
    state = met.withColumn("part", F.col("id"))
    for k in range(rounds + 1):
        if k < rounds:
            order = F.xxhash64("id", F.lit(seed * 1000 + k))
            centre = state.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "part")).alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key", "c")
            pairs = state.join(centre, "key").filter("part <> c.part").groupBy(F.col("id").alias("a")).agg(F.min("c").alias("c")).select("a", F.col("c.id").alias("b"))
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            found = checkpointed(_linked(pairs, sets, least))
        else:
            open_ = state.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum")).filter("lo < hi")
            open_ = open_.groupBy("size", "sum").agg(F.min("key").alias("key")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
            left = state.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))
            left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
            found = checkpointed(_linked_blocks(left.join(sets, "id"), least))
        if found.isEmpty():
            continue
        parts = checkpointed(components(links.union(found)))
        state = met.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
        links = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    classes = members.join(links, F.col("rep") == F.col("a"), "left").select("digest", F.coalesce("b", "rep").alias("class_id"))
    own, of = F.col("id"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    out = signed.join(classes, "digest", "left").select("id", of.alias("class_id"), F.coalesce(of == own, F.lit(True)).alias("kept"))
    if numbers is not None:
        out = out.join(numbers.select(F.col("id").alias("class_id"), F.col("__id").alias("__class")), "class_id", "left").select("id", F.col("__class").alias("class_id"), "kept")
    return renamed(out, numbers, id_col)
