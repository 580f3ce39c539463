"""Ranks, quotas and exact samples that do not gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.

    The rank filter is applied in every map task before the shuffle, so a group
    ships at most ``n`` rows per task however large it is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def hash_order(key: Column | str, seed: int) -> Column:
    """A reproducible random order: md5 of key and seed, as hex text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer): those with the smallest hash.

    The hash is uniform, so a cut slightly above n/N leaves little more than ``n``
    rows for the final ordering; a cut that leaves too few is doubled.
    """
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_h", hash_order(key, seed))
    share = (n + 6 * n**0.5 + 50) / total
    while share < 1:
        below = hashed.where(F.col("_h") < F.lit(f"{int(share * 16**8):08x}"))
        if below.count() >= n:
            hashed = below
            break
        share *= 2
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def smallest_hashes(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The ``n`` of ``total`` rows with the smallest hash of ``key``, in its order.

    Ordering a table for its first rows takes ``n`` rows of every task to one place, so rows above a cut
    slightly over n/total are left out before.
    """
    hashed = df.withColumn("_h", F.xxhash64(key))
    share = (n + 6 * n**0.5 + 50) / max(1, total)
    while share < 1:
        below = hashed.where(F.col("_h") < F.lit(int(share * 2**64) - 2**63))
        if below.count() >= n:
            hashed = below
            break
        share *= 2
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def sample_fraction(df: DataFrame, max_rows: int, rows_per_million: int = 1_000_000,
                    key: str | None = None, seed: int = 42) -> DataFrame:
    """Sample of a large file: fraction min(max_rows / 1e6, 0.1), then at most ``max_rows``."""
    part = df.sample(fraction=min(max_rows / rows_per_million, 0.1), seed=seed)
    return part if key is None else sample_exact(part, key, max_rows, seed)


def mark_per_group(
    df: DataFrame, group: str, key: str, wanted: Column, seed: int = 42, out: str = "marked",
    digits: int = 4,
) -> DataFrame:
    """Mark exactly ``wanted`` rows of each group, those with the smallest hash.

    ``wanted`` is an expression over ``n``, the size of the group. Groups must be few
    (classes of a label); they may be of any size. Counts per leading hash digits tell
    the one bucket in which a group's cut falls, so only that bucket is ordered row by
    row; every other row is marked by comparing its bucket with the cut.
    """
    df = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    buckets = df.groupBy(F.col(group).alias("_g"), "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_g")
    upto = F.sum("_c").over(w.orderBy("_b"))
    cuts = (
        buckets.withColumn("n", F.sum("_c").over(w))
        .withColumn("_w", wanted)
        .withColumn("_below", upto - F.col("_c"))
        .where((F.col("_below") < F.col("_w")) & (F.col("_w") <= F.col("_below") + F.col("_c")))
        .select("_g", F.col("_b").alias("_cut"), (F.col("_w") - F.col("_below")).alias("_take"))
    )
    # One row per group: a handful of classes, so the broadcast stays small.
    joined = df.join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_g")), "left")
    at_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", key))
    clear = joined.where(~at_cut).withColumn(
        out, F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False))
    )
    close = joined.where(at_cut).withColumn(out, rank <= F.col("_take"))
    return clear.unionByName(close).drop("_h", "_b", "_g", "_cut", "_take")


def cap_per_source(df: DataFrame, source: str, order: Sequence[Column | str], limits: dict[str, int]) -> DataFrame:
    """At most ``limits[source]`` rows of each source, in the given order."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    w = Window.partitionBy(source).orderBy(*order)
    most = max(limits.values())
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return ranked.where(F.col("_rn") <= F.coalesce(table[F.col(source)], F.lit(most))).drop("_rn")


def share(df: DataFrame, col: str) -> DataFrame:
    """Frequency and share of each value."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
