"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from derivia.plans.shipping import ship

#: One word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised kernel call works on; longer single texts make a call of their own.
KERNEL_BYTES = 4 << 20
#: Rows in an Arrow batch, so that a batch of long texts stays far below a worker's memory.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_setup(spark: SparkSession) -> None:
    """Small Arrow batches, as rows here are whole documents, and the kernels' code on the executors.

    The size is a setting of the session, read when a plan runs; a smaller one that the caller has stays.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if not 0 < given <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between steps: what the session names, on one machine else a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="derivia-")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpointed_by(df: DataFrame, column: str) -> DataFrame:
    """A checkpoint dealt by a column, so that joins on it need not deal it again.

    Only a plan that is not adaptive tells its checkpoint how it is dealt.
    """
    spark, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        return checkpointed(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), column))
    finally:
        spark.conf.set(adaptive, before)


def with_numbers(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a whole number for each row's id, in the ids' order, and the numbers' meaning, if needed.

    Where ids are whole numbers and none has several rows, they are the numbers and there is no table. Else each id and
    text has a number of its own, so rows that share an id but not a text are told apart and equal rows are not; a null
    id has none. The table (__id, __hash of the text, the number) is ordered by ranges and kept in the checkpoint folder,
    as a rerun must give the same numbers.
    """
    given = F.col(f"`{id_col}`")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType) and docs.filter(given.isNotNull()).groupBy(given.alias("id")).count().filter("count > 1").isEmpty():
        return docs.withColumn(name, given.cast("long")), None
    rows = docs.withColumn("__id", given).withColumn("__hash", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    numbers = checkpointed(rows.filter("__id is not null").select("__id", "__hash").distinct().orderBy("__id", "__hash").withColumn(name, F.monotonically_increasing_id()))
    return rows.join(numbers, ["__id", "__hash"], "left").select(*[F.col(f"`{c}`") for c in docs.columns if c != name], name), numbers


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """id, text with numbers for ids, and what the numbers mean, if needed."""
    rows = docs.select(F.col(f"`{id_col}`").alias("given"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, numbers = with_numbers(rows, "given", "text", "id")
    return rows.select("id", "text"), numbers


def renamed(out: DataFrame, numbers: DataFrame | None, id_col: str) -> DataFrame:
    """The rows with the ids of the input instead of the numbers of `numbered`, as first column id_col."""
    if numbers is None:
        return out.withColumnRenamed("id", id_col)
    rest = [c for c in out.columns if c != "id"]
    return out.join(numbers, "id", "left").select(F.col("__id").alias(id_col), *rest)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about `most` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array and len + 1 offsets; nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n, buffers = len(texts), texts.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: ASCII white space, as the word pattern has it.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def flat_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of all words of the texts, and len + 1 offsets of the texts into them."""
    n = len(data)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial modulo 2^64 and its length.

    The polynomial runs over mixed byte values, so that the low bits of the weights don't cancel.
    """
    table = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
    width = int((ends - starts).max(initial=0))
    if width > 64:  # long spans: hash in blocks, level by level
        out = np.empty(len(starts), np.uint64)
        long = ends - starts > 64
        out[~long] = span_hashes(data, starts[~long], ends[~long])
        import xxhash

        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
        return out
    h = (ends - starts).astype(np.uint64) * _MIX
    at, left = starts.copy(), np.arange(len(starts))
    while len(left):
        left = left[at[left] < ends[left]]
        h[left] = mixed(h[left] + table[data[at[left]]])
        at[left] += 1
    return h
