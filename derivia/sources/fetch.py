"""Fetching reference files: a local path, a cache folder, or the network; on the driver only."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CACHE = Path(".derivia_cache")


def fetch_url(url: str, *, timeout: float = 60, label: str = "", request_url: str | None = None, hint: str = "") -> bytes:
    """The bytes behind url. request_url is what is asked for where it holds a secret; errors show url alone."""
    try:
        with urllib.request.urlopen(request_url or url, timeout=timeout) as answer:
            return answer.read()
    except (OSError, urllib.error.URLError) as e:
        reason = getattr(e, "code", None) or getattr(e, "reason", None) or type(e).__name__
        raise RuntimeError(f"{label or 'fetch'}: {url} failed ({reason}). {hint}".strip()) from None


def _placed(spark: SparkSession, path: str):
    """A path, and the file system that it is on, as Spark's readers see it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, system = _placed(spark, path)
    return system.exists(at)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Put a file where Spark's readers find it; gives the path back."""
    at, system = _placed(spark, path)
    with closing(system.create(at, True)) as out:
        out.write(bytearray(data))
    return path


_memo: dict[tuple[str, str], DataFrame] = {}


def cached_frame(spark: SparkSession, key: str, load: Callable[[], DataFrame], cache_dir: str | os.PathLike | None = CACHE) -> DataFrame:
    """A frame by key: from this session, else from Parquet in the cache folder, else loaded and written there.

    The folder is looked for and written through Spark, so it can be on any file system that all executors share.
    """
    at = (spark.sparkContext.applicationId, key)
    if at in _memo:
        return _memo[at]
    if cache_dir is None:
        df = load()
    else:
        path = f"{os.fspath(cache_dir)}/{hashlib.sha256(key.encode()).hexdigest()[:32]}.parquet"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            load().write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    _memo[at] = df
    return df
