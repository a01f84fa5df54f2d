"""Suffix-array dedup: byte strings that repeat, found by difference-cover suffix sorting of what can repeat at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from derivia.llm._common import numbered, renamed
from derivia.llm.repeats import CROWD, Units, flat_bytes, groups_of, merged_ranges, settled, without

#: Bytes of a repeat, and of the k-grams that anchor it.
LENGTH, GRAM = 100, 24
#: Bytes of snippets that are sorted together.
SORT_BYTES = 1 << 18


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3.

    Sampled suffixes are ranked by their triples; if triples tie, recursion on the names orders them. The others then
    follow from their first symbol and the next rank, and both orders merge by counting.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    a, b, c = s[sample], s[np.minimum(sample + 1, n)], s[np.minimum(sample + 2, n)]
    width = int(s.max()) + 1
    if width < 1 << 21:
        key = (a * width + b) * width + c
        order = np.argsort(key)
        key = key[order]
        fresh = key[1:] != key[:-1]
    else:
        order = np.lexsort((c, b, a))
        a, b, c = a[order], b[order], c[order]
        fresh = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(fresh)))
    if not fresh.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sample = sample[order]
    rest = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    rest = rest[np.argsort(s[rest] * wide + rank[rest + 1])]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    key = lambda i: s[i] * wide + rank[i + 1]
    before = np.searchsorted(key(first), key(rest))
    if width * width < (1 << 62) // int(wide):
        key2 = lambda i: (s[i] * width + s[i + 1]) * wide + rank[i + 2]
        before = before + np.searchsorted(key2(second), key2(rest))
    else:  # names of pairs, so that the key fits
        pairs = np.concatenate((s[second] * np.int64(width) + s[second + 1], s[rest] * np.int64(width) + s[rest + 1]))
        _, named = np.unique(pairs, return_inverse=True)
        before = before + np.searchsorted(named[: len(second)] * wide + rank[second + 2], named[len(second) :] * wide + rank[rest + 2])
    out = np.empty(n + (n % 3 == 1), np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    free = np.ones(len(out), bool)
    free[at] = False
    out[free] = sample
    return out[out < n]


def equal_windows(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of an order share their first `length` bytes with the one before; the data reach far enough."""
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    packed = np.lib.stride_tricks.sliding_window_view(data, 8)
    for k in [*range(0, length - 7, 8), length - 8]:
        at = at[(packed[order[at] + k] == packed[order[at - 1] + k]).all(1)]
    same[at] = True
    return same


def _sorted_parts(parts: DataFrame, length: int) -> DataFrame:
    """Ranges of the snippets' windows of which an equal one of the same anchor starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, SORT_BYTES):
            # Each snippet ends with a symbol of its own kind, so no window of bytes reaches over it.
            data, offsets = flat_bytes(pc.binary_join_element_wise(batch.column("part"), pa.scalar(b"\0", pa.binary()), pa.scalar(b"", pa.binary())))
            symbols = data.astype(np.int64) + 2
            symbols[offsets[1:] - 1] = 1
            order = suffix_array(symbols)
            of = np.searchsorted(offsets, order, "right") - 1
            fits = order + length < offsets[of + 1]
            order, of = order[fits], of[fits]
            same = equal_windows(data, order, length)
            run_ = np.cumsum(~same)
            ids, start = batch.column("id").to_numpy()[of], batch.column("lo").to_numpy()[of] + order - offsets[of]
            by = np.lexsort((start, ids, run_))
            ids, start, run_ = ids[by], start[by], run_[by]
            # Not the first of its run, nor the same place seen in another snippet.
            new_run = np.r_[True, run_[1:] != run_[:-1]]
            head = np.maximum.accumulate(np.where(new_run, np.arange(len(run_)), 0))
            later = (ids != ids[head]) | (start != start[head])
            i, lo, hi = merged_ranges(ids[later], start[later], start[later] + length)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "lo", "hi"])

    return parts.repartition("key").sortWithinPartitions("key").select("key", "id", "lo", "part").mapInArrow(run, "id long, lo int, hi int")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False, crowd: int = CROWD, most_kinds: int = 32_768) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, on request kept_text.

    Every byte goes that a string of `length` bytes covers which also starts earlier: in a document of smaller id, or
    before in its own. Strings are judged on the input, overlaps count, and none crosses documents; a null text counts
    as empty. kept_text leaves out characters that a cut splits.

    Ids may be of any type that has an order. A document with a null id is left whole and marks no other. Equal rows
    (id and text) count as one document, each with a row in the result; rows of one id with different texts are
    documents of their own, the one of the smaller text hash earlier. An empty table gives an empty one. A text is worked
    on in one task, in memory of about fifty times its size, up to 2^32 bytes. Other columns, whatever their names, do
    not matter.

    Bytes that can't be part of a repeat are set aside first (see `repeats`), and equal surroundings are settled by
    their digests. The rest, snippets that share an anchor and differ somewhere, are suffix-sorted: sampled triples,
    recursion on their names, merge of the others, then neighbours' prefixes are compared byte by byte.
    """
    units = Units("bytes", length, gram)
    base, numbers = numbered(docs, id_col, text_col)
    texts, ranges = settled(base, units, True, lambda parts: _sorted_parts(parts, length), crowd, most_kinds)
    return renamed(without(texts, ranges, units, with_text), numbers, id_col)
