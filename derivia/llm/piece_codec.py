"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import arrow_setup, chunks

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of more symbols than this are merged with a heap: a round for each merge would cost their length squared.
LONG_WORD = 256
#: Distinct words that a worker remembers.
KNOWN_WORDS = 120_000
_NONE = np.int32(2**31 - 1)


def _fields(blob: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Number, wire type and value of each field of a protocol-buffer message."""
    at, end = 0, len(blob)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, blob[at : at + n]
            at += n


class PieceModel:
    """The vocabulary of a byte-fallback BPE model with identity normalisation, ready for merge rounds."""

    def __init__(self, blob: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        normalizer: dict[int, bytes | int] = {}
        trainer: dict[int, bytes | int] = {}
        for number, _, value in _fields(blob):
            if number == 1:
                piece = {n: v for n, _, v in _fields(value)}
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = {n: v for n, _, v in _fields(value)}
            elif number == 3:
                normalizer = {n: v for n, _, v in _fields(value)}
        kinds = [k for *_, k in self.pieces]
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or USER_DEFINED in kinds or kinds.count(BYTE) != 256 or trainer.get(3) != 2:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation, without user-defined pieces, are supported")
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(self.pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.unused = {i for i, k in enumerate(kinds) if k == UNUSED}
        if self.unused:
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        # A rank for each score: equal scores share one, and the leftmost pair goes first then.
        _, ranks = np.unique([-s for _, s, _ in self.pieces], return_inverse=True)
        symbols = dict(self.ids)  # and single characters that only occur inside of pieces
        for p in list(self.ids):
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]], symbols[p[k:]]] = i
        self.width = max(symbols.values()) + 2  # the last one stands for characters of no piece
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        made = np.array(list(pairs.values()), np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.slots, self.made = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.probes = 1
        for key, i in zip(keys.tolist(), made.tolist(), strict=True):
            at, n = self._slot(key), 1
            while self.slots[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.slots[at], self.made[at], self.probes = key, i, max(self.probes, n)
        self.ranks = ranks.astype(np.int32)
        self.chars = np.full(0x110000, self.width - 1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.known: dict[str, tuple[list[int], str, bytes]] = {}
        self.raw = [p.replace(SPACE_MARK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, _, k in self.pieces]

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair makes (_NONE: none) and the piece."""
        keys = left.astype(np.int64) * self.width + right
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        piece = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            piece[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return np.where(piece >= 0, self.ranks[piece], _NONE), piece

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that no piece spans the ends of: each a run of marks and what follows up to the next."""
        out: list[list[int]] = [[] for _ in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > LONG_WORD):
            out[i] = self._by_heap(words[i])
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
        if not len(short):
            return out
        points = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32).astype(np.int32)
        sym = self.chars[points]
        word = np.repeat(np.arange(len(short)), lengths[short])
        done_sym, done_point, done_word = [], [], []
        rank, piece = self._ranks(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(word)])
            over = np.repeat(best == _NONE, sizes)
            if over.any():  # compaction: words without a pair go
                done_sym.append(sym[over]), done_point.append(points[over]), done_word.append(word[over])
                keep = ~over
                sym, points, word, rank, piece = sym[keep], points[keep], word[keep], rank[keep], piece[keep]
                sizes, best = sizes[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # the leftmost of each word
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # its place after the right halves are gone
            sym, points, word, rank, piece = sym[keep], points[keep], word[keep], rank[keep], piece[keep]
            touched = np.zeros(len(sym), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            nxt = np.minimum(fresh + 1, len(sym) - 1)
            r, p = self.pair(sym[fresh], sym[nxt])
            r[(fresh + 1 >= len(sym)) | (word[fresh] != word[nxt])] = _NONE
            rank[fresh], piece[fresh] = r, p
        sym, points, word = map(np.concatenate, (done_sym, done_point, done_word))
        order = np.argsort(word, kind="stable")
        sym, points, word = sym[order], points[order], word[order]
        cuts = np.searchsorted(word, np.arange(len(short) + 1))
        odd = sym >= len(self.pieces)
        has_odd = np.zeros(len(short), bool)
        has_odd[word[odd]] = True
        flat, cuts = sym.tolist(), cuts.tolist()
        for k, i in enumerate(short.tolist()):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        for k in np.flatnonzero(has_odd).tolist():
            out[short[k]] = self._with_bytes(out[short[k]], points[cuts[k] : cuts[k + 1]].tolist())
        return out

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, piece = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], piece[:-1] = self.pair(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
        return rank, piece

    def _with_bytes(self, sym: list[int], points: list[int]) -> list[int]:
        """Symbols that are no piece become their bytes."""
        return [x for s, p in zip(sym, points, strict=True) for x in ([s] if s < len(self.pieces) else self.byte_ids[list(chr(p).encode())].tolist())]

    def _by_heap(self, word: str) -> list[int]:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int32)
        sym = self.chars[points].tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, piece = (x.tolist() for x in self._ranks(np.array(sym, np.int32), np.zeros(n, np.int8)))
        heap = [(r, i, sym[i], sym[i + 1], p) for i, (r, p) in enumerate(zip(rank, piece, strict=True)) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            near = [x for x in (before[i], i) if x >= 0 and after[x] >= 0]
            if near:
                r, p = self.pair(np.array([sym[x] for x in near]), np.array([sym[after[x]] for x in near]))
                for x, a, b in zip(near, r.tolist(), p.tolist(), strict=True):
                    if a != _NONE:
                        heapq.heappush(heap, (a, x, sym[x], sym[after[x]], b))
        kept = np.flatnonzero(np.array(sym) >= 0)
        return self._with_bytes([sym[i] for i in kept], points[kept].tolist())

    def word_array(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts (spaces stand for marks), and len + 1 offsets of the texts into them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, SPACE_MARK, " ")
        full = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
        if offsets[-1] == offsets[0]:
            return pa.array([], pa.large_string()), np.zeros(len(full) + 1, np.int64)
        data = np.frombuffer(full.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        at = np.ascontiguousarray(np.r_[starts, len(data)].astype(np.int64))
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))), np.searchsorted(starts, offsets)

    def encode_batch(self, texts: pa.Array) -> tuple[list[tuple[list[int], str, bytes]], np.ndarray, np.ndarray]:
        """Ids of each distinct word with their digits and what they stand for, the distinct word of each word, and the texts' offsets into the words."""
        words, offsets = self.word_array(texts)
        if not len(words):
            return [], np.zeros(0, np.int64), offsets
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        fresh = [w for w in distinct if w not in known]
        if len(known) + len(fresh) > KNOWN_WORDS:
            known.clear()
            fresh = distinct
        for w, ids in zip(fresh, self.encode_words([w.replace(" ", SPACE_MARK) for w in fresh]), strict=True):
            known[w] = ids, ",".join(map(str, ids)), self.decode_bytes(ids)
        return [known[w] for w in distinct], coded.indices.to_numpy(), offsets

    def encode(self, text: str) -> list[int]:
        known, words, _ = self.encode_batch(pa.array([text]))
        return [x for w in words for x in known[w][0]]

    def decode_bytes(self, ids) -> bytes:
        """What the ids stand for, before the dummy prefix goes and bad bytes are replaced."""
        return b"".join([self.raw[i] for i in ids])

    def decode(self, ids) -> str:
        ids = list(ids)
        text = "".join(self._runs(ids))
        first = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
        return text[1:] if first is not None and self.pieces[first][2] == NORMAL and text.startswith(" ") else text

    def _runs(self, ids: list[int]) -> Iterator[str]:
        """Runs of byte pieces are read as UTF-8, each byte that is not becoming U+FFFD."""
        run = b""
        for i in ids:
            if self.pieces[i][2] == BYTE:
                run += self.raw[i]
                continue
            yield _lenient(run)
            run = b""
            yield self.raw[i].decode()
        yield _lenient(run)


def _lenient(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


@lru_cache(maxsize=2)
def _shipped(name: str) -> PieceModel:
    return load(SparkFiles.get(name))


def coded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, one row per document.

    Returns id, the columns to carry, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and on request the ids
    and the decoded text themselves. A null text counts as empty and has no tokens. The vocabulary file goes to the
    executors as a job file and is read once in each worker. Documents are cut into words at the marks, which no piece
    spans; each distinct word of a few megabytes of text is merged once, all of them in the same rounds.

    Repeated rows are encoded each by itself; an empty table gives an empty one; ids may be of any type, and null. A text
    is encoded in one task, in memory of about fifty times its size. Carried columns must not have names of the results;
    other columns, whatever their names, do not matter.
    """
    spark = docs.sparkSession
    arrow_setup(spark)
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    kept = [id_col, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shipped(name)
        for batch in chunks(batches, "__text"):
            known, words, offsets = model.encode_batch(batch.column("__text"))
            counts = np.fromiter((len(x[0]) for x in known), np.int64, len(known))
            total = np.r_[0, np.cumsum(counts[words] if len(words) else words)]
            digits = pa.array([x[1] for x in known], pa.large_string())
            plain = pa.array([x[2] for x in known], pa.large_binary())
            lists = lambda values, sep: pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values.take(pa.array(words))), pa.scalar(sep, values.type))
            numbers = lists(digits, ",").to_pylist()
            texts = [x[1:] if x[:1] == b" " else x for x in lists(plain, b"").to_pylist()]
            out = [*(batch.column(c) for c in kept), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64())]
            out += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in numbers], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            if with_ids:
                flat = np.fromiter((x for w in words for x in known[w][0]), np.int32, total[-1])
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, total[offsets[1:]]], pa.int32()), pa.array(flat, pa.int32())))
            if with_text:
                out.append(pa.array([x.decode() for x in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text])

    return docs.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)
