"""Substring dedup: suffix automata of reference shards, and matching statistics of the text that streams through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from derivia.llm._common import numbered, renamed
from derivia.llm.repeats import CROWD, Units, groups_of, merged_ranges, settled, without

#: Words of a repeat, and of the k-grams that anchor it.
LENGTH, GRAM = 35, 12
#: Bytes of snippets that one automaton holds.
SHARD_BYTES = 1 << 19


class SuffixAutomaton:
    """All substrings of some word sequences, each state with the number of places where its substrings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.ends = [-1], [0], [0]

    def add(self, words: list, weight: int = 1) -> None:
        """Insert a sequence; its places count `weight` each. Sequences don't run into each other."""
        nxt, link, size, ends = self.next, self.link, self.size, self.ends
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
                ends[q] += weight
                continue
            made = len(size)
            if q is None:
                nxt.append({}), link.append(0), size.append(size[last] + 1), ends.append(weight)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = made
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[made] = q if size[p] + 1 == size[q] else self._split(p, w, q)
                last = made
            else:
                last = self._split(last, w, q)
                ends[last] += weight

    def _split(self, p: int, w, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(size)
        nxt.append(dict(nxt[q])), link.append(link[q]), size.append(size[p] + 1), self.ends.append(0)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def close(self) -> None:
        """Pass the numbers of places on to shorter substrings; call once after the last sequence."""
        for i in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[i] > 0:
                self.ends[self.link[i]] += self.ends[i]

    def matching(self, words: list, most: int) -> Iterator[tuple[int, int]]:
        """For each word the length, up to `most`, of the longest match that ends there, and its number of places."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state = length = 0
            while self.size[self.link[state]] >= most if state else False:
                state = self.link[state]
            length = min(length, most)
            yield length, self.ends[state] if state else 0


def shard_ranges(ids: list[int], starts: list[int], many: list[bool], parts: list[list], length: int) -> tuple[list[int], list[int], list[int]]:
    """Ranges of the snippets' windows that have two places or more in the shard that these snippets make up."""
    # Snippets of a document that overlap are one sequence, else a place would count twice.
    order = sorted(range(len(ids)), key=lambda i: (ids[i], starts[i]))
    sequences: list[tuple[int, int, list]] = []
    plain: list[tuple[int, int, list]] = []
    for i in order:
        if many[i]:
            plain.append((ids[i], starts[i], parts[i]))
        if sequences and sequences[-1][0] == ids[i] and starts[i] <= sequences[-1][1] + len(sequences[-1][2]):
            _, lo, words = sequences[-1]
            words.extend(parts[i][lo + len(words) - starts[i] :])
        else:
            sequences.append((ids[i], starts[i], list(parts[i])))
    automaton = SuffixAutomaton()
    for _, _, words in sequences:
        automaton.add(words)
    for _, _, words in plain:  # these have a copy that is not here
        automaton.add(words)
    automaton.close()
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for i, lo, words in sequences:
        at = None
        for k, (matched, places) in enumerate(automaton.matching(words, length)):
            hit = matched >= length and places > 1
            if hit and at is None:
                at = k
            if at is not None and not hit:
                out[0].append(i), out[1].append(lo + at - length + 1), out[2].append(lo + k)
                at = None
        if at is not None:
            out[0].append(i), out[1].append(lo + at - length + 1), out[2].append(lo + len(words))
    return out


def _matched_parts(parts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, SHARD_BYTES):
            found = shard_ranges(*(batch.column(c).to_pylist() for c in ("id", "lo", "many")), [x.split(b" ") for x in batch.column("part").to_pylist()], length)
            i, lo, hi = merged_ranges(*(np.array(x, np.int64) for x in found))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "lo", "hi"])

    return parts.repartition("key").sortWithinPartitions("key").select("key", "id", "lo", "many", "part").mapInArrow(run, "id long, lo int, hi int")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False, crowd: int = CROWD, most_kinds: int = 1024) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, n_spans, on request kept_text.

    Every word goes that a window of `length` words covers whose words also start anywhere else, in this document or
    another. Windows are judged on the input; what is kept is joined by single spaces. A null text has no words.

    Ids may be of any type that has an order. A document with a null id is left whole and marks no other. Equal rows
    (id and text) count as one document, each with a row in the result; rows of one id with different texts are
    documents of their own. An empty table gives an empty one. A text is worked on in one task, in memory of about fifty
    times its size, up to 2^32 words. Other columns, whatever their names, do not matter.

    The corpus is its own reference. Only snippets around anchors that repeat can hold a repeated window (see
    `repeats`); they make up the reference shards, dealt by anchor, so that a window and its copies meet in one shard.
    A shard of bounded size becomes a suffix automaton on the executor that streams the shard's text through it; the
    shards' number grows with the corpus, so sending every automaton everywhere would grow with its square.
    """
    units = Units("words", length, gram)
    base, numbers = numbered(docs, id_col, text_col)
    texts, ranges = settled(base, units, False, lambda parts: _matched_parts(parts, length), crowd, most_kinds)
    out = without(texts, ranges, units, with_text)
    return renamed(out, numbers, id_col).select(f"`{id_col}`", "n_words", "n_removed", "kept_sha256", "n_spans", *["kept_text"] * with_text)
