"""A registry of exact keys as keyed state: what has been seen, with expiry, without a table lookup per batch.

Keys are held in buckets by their hash, one packed value per bucket in the state store, partitioned by
bucket; a batch reads and writes the buckets of the keys it brings and of those whose time is up. A call
into Python and the store costs far more than a key, so it is paid per bucket. The number of buckets is
fixed for the life of a checkpoint; a bucket takes 64 bytes a key. Rows of a batch with equal key and time are
summed up before they are shuffled, so that a key that holds much of a batch costs one row per task and time.

Times: a key is forgotten once the watermark (the latest time of earlier batches less ``delay``) is
``expiry`` or more past its last sighting, and is new when it comes again. Rows older than the watermark
are dropped as late. A replayed batch starts from the state before it and overwrites its own output.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.utils import AnalysisException

from siftline.functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMBINED = "key string, seen_at timestamp, n long, first_seq long"
ENTRY = [("key", "S32"), ("first_seq", "i8"), ("n", "i8"), ("first_ms", "i8"), ("last_ms", "i8")]
BUCKETS = 4096
SEEN = "key string, first_seq long, n long, seen_count long, first_seen timestamp, last_seen timestamp, is_new boolean"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby(["key", "seen_at"], as_index=False).agg(n=("seq", "size"), first_seq=("seq", "min"))


def _per_key(rows: np.ndarray) -> np.ndarray:
    """One entry per key, in order of keys, from any number."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    if not len(rows):
        return rows
    starts = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
    out = rows[starts]
    for name, how in (("first_seq", np.minimum), ("n", np.add), ("first_ms", np.minimum), ("last_ms", np.maximum)):
        out[name] = how.reduceat(rows[name], starts)
    return out


def _entries(b: pd.DataFrame) -> np.ndarray:
    rows = np.empty(len(b), dtype=ENTRY)
    rows["key"], rows["first_seq"], rows["n"] = b["key"].to_numpy().astype("S32"), b["first_seq"], b["n"]
    rows["first_ms"] = rows["last_ms"] = b["seen_at"].astype("datetime64[ms]").astype("int64")
    return rows


class SeenKeys(StatefulProcessor):
    """Per key of a bucket: the first post, how often and when it was seen; forgotten after ``expiry`` milliseconds."""

    def __init__(self, expiry: int | None):
        self.expiry = expiry

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timer long, entries binary")

    def _live(self, timerValues) -> tuple[int | None, np.ndarray]:
        """The bucket's timer and those of its entries, in order of keys, whose time is not up."""
        had = self.seen.get()
        if had is None:
            return None, np.empty(0, dtype=ENTRY)
        held = np.frombuffer(bytes(had[1]), dtype=ENTRY)
        if self.expiry is not None:
            held = held[held["last_ms"] + self.expiry > timerValues.getCurrentWatermarkInMs()]
        return had[0], held

    def _hold(self, held: np.ndarray, timer: int | None) -> None:
        """Keep the entries, and one timer for the first of them to expire."""
        wanted = None if self.expiry is None else int(held["last_ms"].min()) + self.expiry
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.seen.update((wanted, held.tobytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = np.empty(0, dtype=ENTRY)
        for b in rows:
            now = _per_key(np.concatenate([now, _entries(b)]))
        timer, held = self._live(timerValues)
        fresh = ~np.isin(now["key"], held["key"])
        came = now["n"].copy()
        before = held[np.searchsorted(held["key"], now["key"][~fresh])]
        now["first_seq"][~fresh] = before["first_seq"]
        now["n"][~fresh] += before["n"]
        now["first_ms"][~fresh] = np.minimum(now["first_ms"][~fresh], before["first_ms"])
        now["last_ms"][~fresh] = np.maximum(now["last_ms"][~fresh], before["last_ms"])
        every = np.concatenate([held[~np.isin(held["key"], now["key"])], now])
        self._hold(every[np.argsort(every["key"])], timer)
        yield pd.DataFrame({
            "key": now["key"].astype("U32"), "first_seq": now["first_seq"], "n": came, "seen_count": now["n"],
            "first_seen": pd.to_datetime(now["first_ms"], unit="ms", utc=True), "last_seen": pd.to_datetime(now["last_ms"], unit="ms", utc=True),
            "is_new": fresh,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._live(timerValues)
        if len(held):
            self._hold(held, None)  # the timer that fired is gone
        else:
            self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def seen_keys(posts: DataFrame, delay: str = "0 seconds", expiry_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The keyed updates of a stream of ``posts`` (seq, signature, seen_at): a row per key and batch."""
    keyed = posts.select(F.md5(F.lower(X.blank("signature"))).alias("key"), F.col("seen_at").cast("timestamp").alias("seen_at"), F.col("seq").cast("long").alias("seq"))
    combined = keyed.where("seen_at IS NOT NULL").mapInPandas(_combine, COMBINED).withWatermark("seen_at", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return combined.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(SeenKeys(expiry_ms), outputStructType=SEEN, outputMode="Update", timeMode="EventTime")


def run_exact_registry(posts: DataFrame, out: str, checkpoint: str, delay: str = "0 seconds", expiry_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Take all posts that are there through the keyed state; each batch overwrites its own folder."""
    spark = posts.sparkSession
    before = spark.conf.get(PROVIDER)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    spark.conf.set(PROVIDER, ROCKSDB)  # what this kind of state needs; a query keeps the setting it starts with
    try:
        q = (
            seen_keys(posts, delay, expiry_ms, buckets).writeStream.foreachBatch(handle).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    schema = f"{SEEN}, batch_id int"
    try:
        return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch_id=*")
    except AnalysisException as e:  # no batch came
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
