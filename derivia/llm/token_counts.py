"""Token counts of sections, from the offsets of one encoding of the whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import arrow_setup, chunks

RULES = ("start", "most", "end")


class Encoder:
    """Byte-level BPE: the tokens' bytes joined are the text's, so their lengths are the offset mapping."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def ends(self, text: str) -> np.ndarray:
        """The end of each token's span, in bytes."""
        return np.cumsum(self.sizes[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sections: tokens of each section, and those of them that cross its border.

    `starts` are the sections' first bytes, the first 0, ascending; a section reaches to the next one. Every token
    goes to one section: that of its first byte (`start`), of its last (`end`), or of most of its bytes (`most`, the
    earlier if equal), so the sections' counts add up to the document's.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    at = first if rule == "start" else last
    crossing = first != last
    if rule == "most":
        at = first.copy()
        borders = np.r_[starts[1:], np.iinfo(np.int64).max]
        for i in np.flatnonzero(crossing):
            edges = np.r_[begins[i], borders[first[i] : last[i]], ends[i]]
            at[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(starts)
    return np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)


def line_starts(text: bytes) -> np.ndarray:
    """First bytes of the lines; a line holds its line end."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.r_[0, at[at < len(text)]].astype(np.int64)


@lru_cache(maxsize=2)
def _shipped(name: str, pattern: str) -> Encoder:
    return Encoder(SparkFiles.get(name), pattern)


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "start") -> DataFrame:
    """One row per section of each document: id, section, field, n_bytes, n_tokens, n_crossing.

    A section is a line with its line end; the first is the field `title`, the others `body`. The document is encoded
    once as a whole, never section by section, and `rule` says whose a token is that crosses a border. A null or empty
    text has one empty section without tokens. Repeated rows are counted each by itself. An empty table gives an empty one.
    A text is encoded in one task, in memory of about fifty times its size. Ids may be of any type, and null; other
    columns, whatever their names, do not matter.
    """
    spark = docs.sparkSession
    arrow_setup(spark)
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shipped(name, pattern)
        for batch in chunks(batches):
            row, section, size, tokens, crossing = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                starts = line_starts(raw)
                counts, cross = attribute(encoder.ends(text) if text else np.zeros(0, np.int64), starts, rule)
                row.append(np.full(len(starts), i))
                section.append(np.arange(len(starts)))
                size.append(np.diff(np.r_[starts, len(raw)]))
                tokens.append(counts)
                crossing.append(cross)
            number = np.concatenate(section)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(np.concatenate(row))), pa.array(number, pa.int64()), pa.array(np.where(number == 0, "title", "body")), *(pa.array(np.concatenate(x), pa.int64()) for x in (size, tokens, crossing))],
                [id_col, "section", "field", "n_bytes", "n_tokens", "n_crossing"],
            )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, section long, field string, n_bytes long, n_tokens long, n_crossing long"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
