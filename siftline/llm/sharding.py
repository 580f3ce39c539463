"""Random shards by a two-pass external shuffle, in DataFrame operations alone.

Pass 1 scatters the rows by a seeded hash of their id into buckets of about ``bucket_bytes`` of text,
which fit a task's memory. Pass 2 puts each bucket, and the buckets of a task, into a fixed order, so
that the outcome does not hang on the order of arrival, runs Fisher-Yates over each (Spark's ``shuffle``
is the inside-out form) and writes it. The buckets, one after the other, are one random order of all rows;
prefix sums over their counts give every row its rank, and ranks are cut into shards whose row counts
differ by one at most (the law ``rows``). A bucket falls into one or two shards, so files stay large.

Edge cases: null ids are scattered by a hash of their text; rows repeated with one id share a bucket;
an empty table gives no files and an empty result; a null text counts as no bytes; other columns are
carried along, whatever their names, unless called ``shard`` or ``slot``, which raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise, prefix_sums, task_count, text_bytes

BUCKET_BYTES = 16 << 20
LAW = "rows"
MOST_TASKS = 20_000


def _hash(seed: int, doc_id: str, text: str):
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text)))


def write_shards(
    docs: DataFrame, folder: str, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all rows of ``docs`` under ``folder`` as ``shard=0`` to ``shard=<shards - 1>``; returns them with shard and slot."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("the columns shard and slot are added here")
    spark = docs.sparkSession
    buckets = task_count(spark, text_bytes(docs, text), bucket_bytes)
    bucket = F.pmod(_hash(seed, doc_id, text), F.lit(buckets))
    counts = materialise(docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket-counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    bases = prefix_sums(counts, "bucket", "n", "base").select("bucket", "base")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scattered = docs.select(bucket.alias("bucket"), F.struct(_hash(seed + 1, doc_id, text).alias("order"), row.alias("row")).alias("record"))
    tasks = min(buckets, MOST_TASKS)
    # ``shuffle`` draws from one generator per task, so the buckets of a task come in a fixed order.
    gathered = scattered.repartition(tasks, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    shuffled = shuffled.select("bucket", F.posexplode("records").alias("place", "record"))
    # Shard s holds the ranks from ceil(s * total / shards) on.
    shard = F.expr(f"CAST((base + place) * {shards} DIV {max(total, 1)} AS INT)")
    slot = F.expr(f"base + place - (shard * {total}L + {shards - 1}) DIV {shards}")
    placed = (
        shuffled.join(bases, "bucket").withColumn("shard", shard).withColumn("slot", slot.cast("long"))
        .select("record.row.*", "slot", "shard")
    )
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return read_shards(spark, folder, placed.schema)


def read_shards(spark, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)
