"""What both exact substring dedups share: repeated windows of a fixed number of units (bytes or words).

A corpus's windows are too many to be sorted or counted one by one. Every window has a content-chosen anchor: its
leftmost k-gram of the smallest hash. Equal windows have equal anchors, so a window whose anchor's k-gram occurs once
can't be repeated. What remains is small: anchors whose k-gram repeats, each with its context, the units of the windows
that it is the anchor of. Equal contexts are settled by counting them; contexts that share an anchor but differ go to
the operator's own comparison, as snippets grouped by the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import _MIX, SPACE, arrow_setup, checkpointed, chunks, flat_bytes, flat_words, mixed, span_hashes

#: Text bytes that the anchors are chosen in at a time: their arrays, eight bytes a unit, then stay in a core's cache.
ANCHOR_BYTES = 1 << 18
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)


@dataclass(frozen=True)
class Units:
    """What a text is made of: `bytes`, or `words` joined by single spaces; window length and k-gram size in units."""

    kind: str
    length: int
    gram: int

    def parse(self, texts: pa.Array) -> Parsed:  # of text or bytes
        data, offsets = flat_bytes(texts)
        if self.kind == "bytes":
            at = np.arange(len(data) + 1)
            return Parsed(data, at[:-1], at[1:], offsets, _BYTES[data])
        starts, ends, of = flat_words(data, offsets)
        # Canonical form: each word and one space behind it.
        keep = ~SPACE[data]
        sizes = ends - starts + 1
        flat = np.full(int(sizes.sum()), 32, np.uint8)
        ends_now = np.cumsum(sizes) - 1
        solid = np.ones(len(flat), bool)
        solid[ends_now] = False
        flat[solid] = data[keep]
        starts_now = ends_now - sizes + 1
        return Parsed(flat, starts_now, ends_now, of, span_hashes(flat, starts_now, ends_now))


@dataclass(frozen=True)
class Parsed:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    values: np.ndarray

    def span(self, a: int, b: int) -> bytes:
        """The bytes of units a to b - 1."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes() if b > a else b""


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row, by doubling."""
    out, done, power, size = None, 0, values, 1
    left = k
    while left:
        if left & 1:
            out = power if out is None else mixed(out[: len(out) - size] * _MIX + power[done : done + len(out) - size]) if len(out) > size else out[:0]
            done += size
        left >>= 1
        if left:
            power = power[: max(len(power) - size, 0)] * _STEP + power[size:]
            power ^= power >> np.uint64(29)
            size *= 2
    return mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], for every i that has so many."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


@dataclass(frozen=True)
class Anchors:
    """Anchors `at` by flat unit position, the windows `lo` to `hi` (units of all windows that an anchor stands for), and all k-gram hashes."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    grams: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        """Hashes of the anchors' k-grams, mixed once more, as an anchor's own hash is a small one."""
        return mixed(self.grams[self.at] ^ _STEP)


def anchors(parsed: Parsed, units: Units) -> Anchors:
    """The anchor of every window is the leftmost of its k-grams of the smallest hash, by its upper half.

    Windows of one anchor start side by side, so each window belongs to one anchor and its copies to anchors of the same
    k-gram, with the anchor at the same place in them.
    """
    n, k, w = len(parsed.values), units.gram, units.length - units.gram + 1
    none = np.zeros(0, np.int64)
    if n < units.length:
        return Anchors(none, none, none, np.zeros(0, np.uint64))
    if n >= 1 << 32:
        raise ValueError("a text of 2^32 units or more")
    grams = gram_hashes(parsed.values, k)
    low = np.uint64(0xFFFFFFFF)
    where = (_sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w) & low).astype(np.int64)
    # Windows that cross a document's end count for nothing; units.length - 1 of them lie between two documents' windows.
    whole = np.repeat(parsed.offsets[1:], np.diff(parsed.offsets))[: len(where)] - np.arange(len(where)) >= units.length
    starts = np.flatnonzero(whole)
    if not len(starts):
        return Anchors(none, none, none, grams)
    where = where[starts]
    fresh = np.r_[True, (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(starts)] - 1
    return Anchors(where[first], starts[first], starts[last] + units.length, grams)


def _documents(parsed: Parsed, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(parsed.offsets, at, "right") - 1


def _take(ids: pa.Array, rows: np.ndarray) -> pa.Array:
    return ids.take(pa.array(rows))


def context_hashes(grams: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, units: Units) -> np.ndarray:
    """A hash of each anchor's context, units lo to hi - 1, and of where in it the anchor is, from hashes of its k-grams."""
    k = units.gram
    out = (at - lo).astype(np.uint64) * _STEP + (hi - at).astype(np.uint64)
    for j in [*range(0, 2 * (units.length - k) + 1, k), 2 * units.length]:
        out = mixed(out * _MIX + grams[np.minimum(lo + j, hi - k)])
    return out


def _counted(docs: DataFrame, units: Units) -> DataFrame:
    """key, n of the anchors' k-grams that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=ANCHOR_BYTES):
            h = np.sort(anchors(units.parse(batch.column("text")), units).keys)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)]).astype(np.int32))], ["key", "n"])

    return docs.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


#: A table of keys has so many bits at most (32 MB), and as many segments as a power of two, each made by one task.
TABLE_BITS, SEGMENT_BITS = 28, 4


@dataclass(frozen=True)
class KeyTable:
    """A bit for each value of a hash's first bits: whether a key has them. What it lets through may be no key."""

    bits: int
    marks: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def key_table(keys: DataFrame, count: int, each: int = 16, most_bits: int = TABLE_BITS) -> KeyTable:
    """The table of `count` keys: `each` bits or more for each, up to its fixed size. Fuller tables let more through."""
    bits = int(np.clip(np.ceil(np.log2(each * max(count, 1))), SEGMENT_BITS + 3, most_bits))
    marks = np.zeros(1 << (bits - 3), np.uint8)
    if not count:
        return KeyTable(bits, marks)
    size = 1 << (bits - 3 - SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            segment = (at >> np.uint64(bits - SEGMENT_BITS)).astype(np.int64)
            for k in np.unique(segment).tolist():
                own = at[segment == k] & np.uint64((1 << (bits - SEGMENT_BITS)) - 1)
                np.bitwise_or.at(segments.setdefault(k, np.zeros(size, np.uint8)), own >> np.uint64(3), np.uint8(1) << (own & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(segments), pa.int32()), pa.array([x.tobytes() for x in segments.values()], pa.binary())], ["segment", "marks"])

    dealt = keys.select("key").repartition(1 << SEGMENT_BITS, F.shiftrightunsigned("key", 64 - SEGMENT_BITS))
    for segment, part in dealt.mapInArrow(run, "segment int, marks binary").collect():  # one row a segment, of fixed size
        marks[segment * size : (segment + 1) * size] |= np.frombuffer(part, np.uint8)
    return KeyTable(bits, marks)


#: Contents of `places`.
_PLACE = np.dtype([("id", np.int64), ("pos", np.int64)])
_PLACED = "key long, ctx long, before int, behind int, places binary"


def _placed(docs: DataFrame, units: Units, repeated, frequent, hot: bool) -> DataFrame:
    """key, ctx, before, behind, places: the anchors of each context, which reaches from pos - before to pos + behind.

    Only of keys in the table `repeated`, and those in the table `frequent` or, unless `hot`, those not in it; the tables are
    broadcast variables. The places of a context in some text make one row, so that copies do not crowd the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=ANCHOR_BYTES):
            parsed = units.parse(batch.column("text"))
            found = anchors(parsed, units)
            keys = found.keys
            own = repeated.value.has(keys)
            own[own] &= frequent.value.has(keys[own]) == hot
            if not own.any():
                continue
            at, lo, hi, h = found.at[own], found.lo[own], found.hi[own], keys[own]
            ctx = context_hashes(found.grams, at, lo, hi, units)
            order = np.lexsort((ctx, h))
            at, h, lo, hi, ctx = (x[order] for x in (at, h, lo, hi, ctx))
            of = _documents(parsed, at)
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])])
            places = np.empty(len(at), _PLACE)
            places["id"], places["pos"] = batch.column("id").to_numpy()[of], at - parsed.offsets[of]
            ends = np.r_[first, len(at)].astype(np.int32) * _PLACE.itemsize
            packed_ = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(places.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(ctx[first].view(np.int64)), pa.array((at - lo)[first].astype(np.int32)), pa.array((hi - at)[first].astype(np.int32)), packed_], ["key", "ctx", "before", "behind", "places"])

    return docs.filter("id is not null").mapInArrow(run, _PLACED)


def _unfolded(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places, and how many each element has."""
    data, offsets = flat_bytes(places)
    return np.frombuffer(data.tobytes(), _PLACE), np.diff(offsets) // _PLACE.itemsize


def _each_place(placed: DataFrame) -> DataFrame:
    """A row for each place: key, ctx, id, pos, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = _unfolded(batch.column("places"))
            key, ctx, before, behind = (np.repeat(batch.column(c).to_numpy(), n) for c in ("key", "ctx", "before", "behind"))
            pos = place["pos"].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ctx, place["id"].copy(), pos, pos - before, pos + behind)], ["key", "ctx", "id", "pos", "lo", "hi"])

    return placed.mapInArrow(run, "key long, ctx long, id long, pos int, lo int, hi int")


def _judged(grouped: DataFrame, keep_first: bool, most_kinds: int) -> DataFrame:
    """What the places of one k-gram say: id, lo, hi, key, ask, hot; ask is null for a range to remove.

    Input: key, seen (array of ctx, before, behind, places), bounded by `crowd`. Of each context that occurs again all
    places, or all but the first, are to remove. If there are several contexts, the first place of each has to be
    compared: ask says whether the context occurs again, hot that there are more than `most_kinds` contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column("seen")
            flat = seen.flatten()
            place, n = _unfolded(flat.field("places"))
            row = np.repeat(np.repeat(np.arange(len(batch)), pc.list_value_length(seen).to_numpy(zero_copy_only=False)), n)
            ctx, before, behind = (np.repeat(flat.field(x).to_numpy(), n) for x in ("ctx", "before", "behind"))
            ids, pos = place["id"], place["pos"]
            order = np.lexsort((pos, ids, ctx, row))
            row, ctx, ids, pos, before, behind = (x[order] for x in (row, ctx, ids, pos, before, behind))
            first = np.r_[True, (row[1:] != row[:-1]) | (ctx[1:] != ctx[:-1])][: len(row)]
            single = first | np.r_[True, (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])][: len(row)]  # a row that repeats is one place
            group = np.cumsum(first) - 1
            many = (np.bincount(group, single) > 1)[group] if len(group) else first
            kinds = np.bincount(row[first], minlength=len(batch))[row]
            remove = many & single & (~first if keep_first else True)
            ask = first & (kinds > 1)
            pick = np.r_[np.flatnonzero(remove), np.flatnonzero(ask)]
            verdict = [None] * int(remove.sum()) + many[ask].tolist()
            hot = np.r_[np.zeros(int(remove.sum()), bool), kinds[ask] > most_kinds]
            yield pa.RecordBatch.from_arrays([pa.array(ids[pick].copy()), pa.array((pos - before)[pick].astype(np.int32)), pa.array((pos + behind)[pick].astype(np.int32)), pa.array(batch.column("key").to_numpy()[row][pick]), pa.array(verdict, pa.bool_()), pa.array(hot)], ["id", "lo", "hi", "key", "ask", "hot"])

    return grouped.mapInArrow(run, "id long, lo int, hi int, key long, ask boolean, hot boolean")


def packed(docs: DataFrame) -> DataFrame:
    """id and the text, compressed, so that its one shuffle moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([pack((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], ["id", "text"])

    return docs.mapInArrow(run, "id long, text binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts' bytes again, some at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in chunks(batches, most=ANCHOR_BYTES // 2):
        texts = pa.array([unpack(x) for x in batch.column("text").to_pylist()], pa.large_binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)


def snippets(asked: DataFrame, units: Units) -> DataFrame:
    """The bytes of unit ranges. Input: id, text, asked (array of key, lo, hi, many; null for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batch.filter(pc.is_valid(batch.column("asked"))) for batch in batches):
            parsed = units.parse(batch.column("text"))
            rows = batch.column("asked")
            of = np.repeat(np.arange(len(batch)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
            flat = rows.flatten()
            lo, hi = (np.minimum(flat.field(x).to_numpy() + parsed.offsets[of], parsed.offsets[of + 1]) for x in ("lo", "hi"))
            yield pa.RecordBatch.from_arrays([flat.field("key"), _take(batch.column("id"), of), flat.field("lo"), flat.field("many"), pa.array([parsed.span(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["key", "id", "lo", "many", "part"])

    return asked.mapInArrow(run, "key long, id long, lo int, many boolean, part binary")


#: Places of one k-gram that a task judges, 16 bytes each; those of a more frequent one are counted with partial sums.
CROWD = 65_536
#: Parts that the places of one frequent context or window are dealt to.
SALT = 16


def _salted(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """An inner join with one row of `few` for many of `rows`, whose rows (with an id) go to several tasks."""
    spread = few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(spread, [*on, "salt"])


def settled(docs: DataFrame, units: Units, keep_first: bool, compare: Callable[[DataFrame], DataFrame], crowd: int = CROWD, most_kinds: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Packed texts by id (id, text, hash-partitioned), and unit ranges to remove (id, lo, hi).

    keep_first: a window goes if an equal one starts earlier, by (id, position); else if an equal one starts anywhere
    else. `compare` gets the snippets (key, id, lo, many, part) of anchors with different contexts, up to `most_kinds`
    of them, `many` for contexts that occur more than once, and returns ranges. Where more contexts share an anchor, as
    in a frequent line with ever new surroundings, their windows are counted by digests. k-grams with more than `crowd`
    places never meet in a task: their contexts are counted with partial sums.

    The k-grams that repeat go to the executors as a bit table of a fixed size at most, so that places of others are
    dropped where they are found; those that a full table lets through are judged alone and settle nothing. A second
    table tells frequent ones, and both ways of judging are right for any k-gram, so its errors change no result.
    """
    spark = docs.sparkSession
    arrow_setup(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(_counted(docs, units))
    crowds = counts.filter(F.col("n") > crowd)
    repeats, crowded = counts.agg(F.count("*"), F.count_if(F.col("n") > crowd)).first()
    # Of a frequent k-gram's table a bit in 4,096 is set, as what it lets through moves more data.
    repeated, frequent = (spark.sparkContext.broadcast(key_table(*x)) for x in ((counts, repeats, 16), (crowds, crowded, 4096)))
    usual = _placed(docs, units, repeated, frequent, False)
    seen = usual.groupBy("key").agg(F.collect_list(F.struct("ctx", "before", "behind", "places")).alias("seen"))
    verdicts = checkpointed(_judged(seen, keep_first, most_kinds))
    full = verdicts.filter("ask is null").select("id", "lo", "hi")
    asks = verdicts.filter("ask is not null").select("id", "hot", F.struct("key", "lo", "hi", F.col("ask").alias("many")).alias("ask"))
    if crowded:
        hot = _each_place(_placed(docs, units, repeated, frequent, True))
        each = checkpointed(hot.groupBy("key", "ctx").agg(F.min(F.struct("id", "pos", "lo", "hi")).alias("first"), F.max(F.struct("id", "pos")).alias("last")))
        again = F.expr("first.id <> last.id or first.pos <> last.pos")
        copies = _salted(hot, each.filter(again).select("key", "ctx", "first"), ["key", "ctx"])
        full = full.union((copies.filter("id <> first.id or pos <> first.pos") if keep_first else copies).select("id", "lo", "hi"))
        asks = asks.union(each.select("first.id", F.lit(True).alias("hot"), F.struct("key", "first.lo", "first.hi", again.alias("many")).alias("ask")))
    texts = packed(docs).repartition(n, "id")

    def parts(which: DataFrame) -> DataFrame:
        # A left join, as an inner one would filter the texts first, and their one shuffle could not be used again.
        return snippets(texts.join(which.groupBy("id").agg(F.collect_list("ask").alias("asked")), "id", "left").select("id", "text", "asked"), units)

    ranges = full.union(compare(parts(asks.filter("not hot"))))
    if crowded or not asks.filter("hot").isEmpty():
        ranges = ranges.union(_by_windows(parts(asks.filter("hot")), units, keep_first))
    return texts, ranges


def _by_windows(parts: DataFrame, units: Units, keep_first: bool) -> DataFrame:
    """Ranges of repeated windows of the snippets, by a digest of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "part", ANCHOR_BYTES):
            parsed = units.parse(batch.column("part"))
            room = np.repeat(parsed.offsets[1:], np.diff(parsed.offsets)) - np.arange(len(parsed.values))
            at = np.flatnonzero(room >= units.length)
            of = _documents(parsed, at)
            digests = [hashlib.blake2b(parsed.span(i, i + units.length), digest_size=16).digest() for i in at.tolist()]
            starts = batch.column("lo").to_numpy()[of] + (at - parsed.offsets[of]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _take(batch.column("id"), of), pa.array(starts, pa.int32()), _take(batch.column("many"), of)], ["w", "id", "lo", "many"])

    windows = parts.mapInArrow(run, "w binary, id long, lo int, many boolean")
    place = F.struct("id", "lo")
    first = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("many").alias("some")).filter("some or first.id <> last.id or first.lo <> last.lo")
    again = _salted(windows, first.select("w", "first"), ["w"])
    if keep_first:
        again = again.filter("id <> first.id or lo <> first.lo")
    return again.select("id", "lo", (F.col("lo") + units.length).alias("hi"))


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by key, joined so that none splits a key and each holds about `most` bytes of parts."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column("key").to_numpy()
        cut = len(keys) if final else int(np.searchsorted(keys, keys[-1]))
        if cut:
            sums = np.cumsum(pc.binary_length(whole.column("part")).to_numpy()[:cut])
            edges = [0]
            while edges[-1] < cut:
                a = edges[-1]
                b = int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right"))
                b = min(max(b, a + 1), cut)
                b = max(int(np.searchsorted(keys[:cut], keys[b - 1], "right")), a + 1) if b < cut else cut
                edges.append(b)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield whole.slice(a, b - a)
        rest = whole.slice(cut)
        held, size = ([rest] if len(rest) else []), int(pc.sum(pc.binary_length(rest.column("part"))).as_py() or 0)

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += int(pc.sum(pc.binary_length(batch.column("part"))).as_py())
            if size >= most:
                yield from flush(False)
    if held:
        yield from flush(True)


def merged_ranges(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each id, overlapping and touching ones joined."""
    order = np.lexsort((lo, ids))
    ids, lo, hi = ids[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(ids):
        return ids, lo, hi
    fresh_id = np.r_[True, ids[1:] != ids[:-1]]
    block = np.cumsum(fresh_id) - 1
    span = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + block * span) - block * span
    new = fresh_id | np.r_[True, lo[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return ids[first], lo[first], np.maximum.reduceat(hi, first)


def without(texts: DataFrame, ranges: DataFrame, units: Units, with_text: bool) -> DataFrame:
    """One row per text: id, n_units, n_removed, n_spans, kept_sha256, and on request the kept text."""
    spans = texts.join(ranges.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "id", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            parsed = units.parse(batch.column("text"))
            n, rows = len(parsed.values), batch.column("spans")
            of = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
            flat = rows.flatten()
            change = np.zeros(n + 1, np.int64)
            if len(of):
                for end, by in (("lo", 1), ("hi", -1)):
                    np.add.at(change, np.minimum(flat.field(end).to_numpy() + parsed.offsets[of], parsed.offsets[of + 1]), by)
            gone = np.cumsum(change)[:n] > 0
            # A removed run starts where the unit before is kept or belongs to another text.
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = parsed.offsets[1:-1]
            inner = inner[inner < n]
            begins[inner] |= gone[inner]
            sums, runs = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
            bounds = parsed.offsets
            kept_texts = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if sums[b] == sums[a]:
                    kept_texts.append(parsed.span(a, b))
                    continue
                keep = np.flatnonzero(~gone[a:b]) + a
                if units.kind == "bytes":
                    kept_texts.append(parsed.data[keep].tobytes())
                else:
                    kept_texts.append(b" ".join([parsed.span(i, i + 1) for i in keep.tolist()]))
            out = [batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64()), pa.array(runs[bounds[1:]] - runs[bounds[:-1]], pa.int64())]
            out.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts], pa.string()))
            if with_text:
                # A cut inside of a character leaves bytes that are no text; they go.
                out.append(pa.array([x.decode(errors="ignore") for x in kept_texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", f"n_{units.kind}", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    schema = f"id long, n_{units.kind} long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return spans.mapInArrow(run, schema)
