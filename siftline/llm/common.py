"""Helpers shared by the training-data operators.

Functions of these modules that run in tasks travel with the task, so executors need not have the
package installed.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.session import scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


def travels(name: str) -> None:
    """Let the functions of module ``name`` be pickled with the tasks that use them."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as this Python worker, over all its tasks."""
    state = sys.modules.setdefault("_siftline_worker_state", types.ModuleType("_siftline_worker_state"))
    return state.__dict__.setdefault(name, {})


# ---- words and shingles ------------------------------------------------------------------------

WORDS_KEPT = 300_000


def words_in(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of frequent words are remembered."""
    known = worker_cache("word_hashes")
    if len(known) > WORDS_KEPT:
        known.clear()
    fresh = [w for w in set(words) if w not in known]
    known.update(zip(fresh, map(xxhash.xxh64_intdigest, fresh)))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of ``k`` words, in order; a shorter text is one window, an empty one none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out ^= words[i : n - k + 1 + i]
        out *= MIX
        out ^= out >> SHIFT
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(words_in(text)), k))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


# ---- files and tables --------------------------------------------------------------------------


def filesystem(uri: str):
    """The file system and path behind a URI, as Arrow opens it in a task."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, tidy: bool = False, **options) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from the written table.

    If ``tidy``, its shuffle files are deleted once the table is written, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        if tidy:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``materialise`` or an operator wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def prefix_sums(df: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows whose integer ``key`` is smaller.

    ``key`` is distinct. Sums are taken per block of keys and then over the block totals, so that
    no window holds more than ``block`` rows or the number of blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    total = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_part", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(total, "_block")
        .withColumn(out, (F.col("_base") + F.col("_part")).cast("long"))
        .drop("_block", "_part", "_base")
    )


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0


def task_count(spark: SparkSession, total: int, per_task: int) -> int:
    """Tasks for ``total`` bytes, never fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-total // per_task))
