"""Hard negatives: exact top-k searches by inner product over length buckets with sorted coordinate lists.

Rows are quantised to integers. They are sorted by length and cut into buckets; a bucket holds its rows'
ids, labels and vectors and, for each coordinate, its rows in order of that coordinate of the unit vectors.

A search has anchors with windows of scores (low, high) and wants, per window, the first k rows by
(score descending, id) whose score lies inside. Per anchor and bucket:

1. No score of the bucket exceeds the anchor's length times the bucket's greatest length: if that is
   below the anchor's bound (its k-th score so far, or the low end), the bucket is skipped.
2. The bound gives a least cosine. With it each of the anchor's focus coordinates (the largest of its
   unit vector) has a range of feasible values, which the sorted lists turn into a set of rows.
3. The sets are intersected, and their rows are verified by exact integer inner products. Anchors whose
   smallest set is still most of the bucket are verified against all of it, in one matrix product.

Bounds start from the exact scores of ``SEED_ROWS`` rows, those with the smallest hash of their id (the
documented bound of what is broadcast), and rise from bucket to bucket. Buckets and chunks of anchors
meet in groups of bounded size; a group returns k rows at most per window.

The first search finds positives (rows of the anchor's label, other than itself), the second one
negatives: rows of other labels whose score is between two shares of the positive's.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
components beyond 2^26 after quantisation are cut to it; shorter vectors count as filled with zeros;
equal rows count once; rows that share an id but differ are rows of their own, never partners of each
other; equal scores go by id, then label; tables without rows or anchors give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialise, travels

travels(__name__)

BUCKET = 2048
CHUNK = 1024
SEED_ROWS = 4096
GROUP_BUCKETS = 32
GROUP_CHUNKS = 8
FOCUS = 5
SELECTIVE = 0.25
SIMILAR = 0.9
LARGEST = 1 << 26
NONE = -(1 << 62)
SLACK = 1e-6

BUCKETS = "bucket long, longest double, ids binary, labels binary, vectors binary, orders binary"
CHUNKS = "chunk long, ids binary, tags binary, labels binary, vectors binary, low binary, high binary, bound binary"
FOUND = "anchor_id long, tag long, w int, id long, label long, score long"


# ---- rows --------------------------------------------------------------------------------------


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, vec) of the rows that take part, each once; ``vec`` holds integers."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), doubles.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return rows.select("id", "label", whole.alias("vec")).distinct()


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int32)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(_lengths(v), 1e-300)[:, None]).astype(np.float32)


# ---- the index ---------------------------------------------------------------------------------


def bucket_row(number: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
    return {
        "bucket": number, "longest": float(_lengths(v).max()), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(),
        "vectors": v.astype("<i4").tobytes(), "orders": np.argsort(_unit(v), 0, kind="stable").T.astype("<u2").tobytes(),
    }


def _cut(dims: int, size: int):
    def packed(number: int, rows: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([bucket_row(number, rows["id"].to_numpy(), rows["label"].to_numpy(), v)])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets of ``size`` rows at most; past an eighth of it, at the first row a tenth shorter than the longest."""
        number, held = TaskContext.get().partitionId() << 32, None
        for b in chain(batches, [None]):
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            while held is not None and len(held) >= (size if b is not None else 1):
                rows = held[:size]
                v = _matrix(rows["vec"].tolist(), dims)
                length = _lengths(v)
                end = max(int((length >= SIMILAR * length[0]).sum()), min(-(-size // 8), len(rows)))
                yield packed(number, rows[:end], v[:end])
                held, number = held[end:], number + 1

    return cut


def build_index(rows: DataFrame, dims: int, count: int, size: int = BUCKET) -> DataFrame:
    """Length buckets of ``rows`` (id, label, vec): one row per bucket, written to the shared folder."""
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // size)), count // (16 * size))
    order = [F.col("length").desc(), F.col("id"), F.col("label")]
    dealt = rows.withColumn("length", length).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("length")
    return materialise(dealt.mapInPandas(_cut(dims, size), BUCKETS), "length-buckets")


class Bucket:
    def __init__(self, row, dims: int):
        self.longest = row.longest
        self.ids, self.labels = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8")
        n = len(self.ids)
        self.vectors = np.frombuffer(row.vectors, "<i4").reshape(n, dims)
        self.unit = _unit(self.vectors)
        self.orders = np.frombuffer(row.orders, "<u2").reshape(dims, n)
        self.sorted = np.take_along_axis(self.unit.T, self.orders.astype(np.int64), 1)


# ---- the search --------------------------------------------------------------------------------


class Anchors:
    """A chunk of anchors with their windows (anchors x windows) and bounds, which rise."""

    def __init__(self, ids, tags, labels, vectors, low, high, bound):
        self.ids, self.tags, self.labels, self.vectors = ids, tags, labels, vectors
        self.low, self.high, self.bound = low, high, bound.copy()
        self.length = _lengths(vectors)
        unit = _unit(vectors).astype(np.float64)
        self.focus = np.argsort(-np.abs(unit), 1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, 1), -1, 1))
        empty = np.zeros(0, np.int64)
        self.best = [(empty, empty, empty, empty)] * low.shape[1]  # anchor, score, id, label

    def keep(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> None:
        """Take verified rows into the windows they lie in, and raise the bounds."""
        for w in range(self.low.shape[1]):
            own = (score >= np.maximum(self.bound[anchor, w], self.low[anchor, w])) & (score <= self.high[anchor, w])
            if not own.any():
                continue
            a, s, i, x = (np.concatenate(pair) for pair in zip(self.best[w], (anchor[own], score[own], ids[own], labels[own])))
            order = np.lexsort((x, i, -s, a))
            a, s, i, x = a[order], s[order], i[order], x[order]
            place = np.arange(len(a)) - np.searchsorted(a, a, "left")
            full = place == k - 1
            self.bound[a[full], w] = np.maximum(self.bound[a[full], w], s[full])
            self.best[w] = tuple(c[place < k] for c in (a, s, i, x))


def _products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products; no partial sum exceeds ``longest``, the product of the lengths."""
    kind = np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def candidates(anchors: Anchors, bucket: Bucket) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Anchors to verify against the whole bucket, and (anchor, rows) of those with small feasible sets."""
    least = np.where(anchors.low <= anchors.high, np.maximum(anchors.bound, anchors.low), -NONE).min(1).astype(np.float64)
    reach = anchors.length * bucket.longest
    cosine = np.where(reach > 0, least / np.maximum(reach, 1e-300), np.where(least > 0, 2.0, -1.0))
    cosine -= 1e-9 * np.abs(cosine)
    (live,) = (cosine <= 1).nonzero()
    bounded = live[cosine[live] > 0]
    n = len(bucket.ids)
    first, last = np.zeros((len(bounded), anchors.focus.shape[1]), np.int64), np.full((len(bounded), anchors.focus.shape[1]), n)
    spread = np.arccos(np.clip(cosine[bounded], 0, 1))[:, None]
    lowest = np.cos(np.minimum(np.pi, anchors.angle[bounded] + spread)) - SLACK
    highest = np.cos(np.maximum(0, anchors.angle[bounded] - spread)) + SLACK
    focus = anchors.focus[bounded]
    for f in np.unique(focus):
        at = focus == f
        first[at] = np.searchsorted(bucket.sorted[f], lowest[at], "left")
        last[at] = np.searchsorted(bucket.sorted[f], highest[at], "right")
    size = np.maximum(last - first, 0)
    small = size.min(1, initial=n) <= SELECTIVE * n
    sets = []
    for i in small.nonzero()[0]:
        by_size = np.argsort(size[i], kind="stable")
        j = by_size[0]
        rows = bucket.orders[focus[i, j], first[i, j] : max(last[i, j], first[i, j])].astype(np.int64)
        for j in by_size[1:]:
            if size[i, j] < n and len(rows):
                values = bucket.unit[rows, focus[i, j]]
                rows = rows[(values >= lowest[i, j]) & (values <= highest[i, j])]
        if len(rows):
            sets.append((int(bounded[i]), rows))
    return np.setdiff1d(live, bounded[small], assume_unique=True), sets


def search_bucket(anchors: Anchors, bucket: Bucket, k: int, same_label: bool) -> None:
    whole, sets = candidates(anchors, bucket)
    if len(whole):
        reach = float(anchors.length[whole].max()) * bucket.longest
        scores = _products(anchors.vectors[whole], bucket.vectors, reach)
        allowed = (anchors.labels[whole][:, None] == bucket.labels[None, :]) == same_label
        allowed &= anchors.ids[whole][:, None] != bucket.ids[None, :]
        inside = np.zeros(scores.shape, bool)
        for w in range(anchors.low.shape[1]):
            low = np.maximum(anchors.bound[whole, w], anchors.low[whole, w])[:, None].astype(scores.dtype)
            inside |= (scores >= low) & (scores <= anchors.high[whole, w][:, None].astype(scores.dtype))
        a, r = (inside & allowed).nonzero()
        anchors.keep(whole[a], scores[a, r].astype(np.int64), bucket.ids[r], bucket.labels[r], k)
    for a, rows in sets:
        rows = rows[((bucket.labels[rows] == anchors.labels[a]) == same_label) & (bucket.ids[rows] != anchors.ids[a])]
        if len(rows):
            score = _products(bucket.vectors[rows], anchors.vectors[a : a + 1], anchors.length[a] * bucket.longest)[:, 0].astype(np.int64)
            anchors.keep(np.full(len(rows), a), score, bucket.ids[rows], bucket.labels[rows], k)


def _chunked(dims: int, windows: int, k: int, same_label: bool, seeds, size: int):
    """Packs anchors into chunks, with bounds from the exact scores of the seed rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, bucket = TaskContext.get().partitionId(), 0, None
        if seeds.value is not None:
            bucket = Bucket(pd.Series(seeds.value), dims)
        for b in batches:
            for s in range(0, len(b), size):
                c = b[s : s + size]
                low, high = np.ones((len(c), windows), np.int64), np.zeros((len(c), windows), np.int64)
                for i, (x, y) in enumerate(zip(c["low"], c["high"])):
                    low[i, : len(x)], high[i, : len(y)] = x, y
                ids, tags, labels = (c[name].to_numpy(np.int64) for name in ("id", "tag", "label"))
                anchors = Anchors(ids, tags, labels, _matrix(c["vec"].tolist(), dims), low, high, np.full(low.shape, NONE))
                if bucket is not None:
                    search_bucket(anchors, bucket, k, same_label)
                yield pd.DataFrame([{
                    "chunk": part << 32 | no, "ids": ids.tobytes(), "tags": tags.tobytes(), "labels": labels.tobytes(),
                    "vectors": anchors.vectors.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "bound": anchors.bound.tobytes(),
                }])
                no += 1

    return pack


def _group(dims: int, windows: int, k: int, same_label: bool):
    def search(chunks: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = [Bucket(r, dims) for r in buckets.sort_values("longest", ascending=False).itertuples()] if len(chunks) else []
        for c in chunks.itertuples():
            ids, tags, labels = (np.frombuffer(x, np.int64) for x in (c.ids, c.tags, c.labels))
            low, high, bound = (np.frombuffer(x, np.int64).reshape(-1, windows) for x in (c.low, c.high, c.bound))
            anchors = Anchors(ids, tags, labels, np.frombuffer(c.vectors, np.int32).reshape(-1, dims), low, high, bound)
            for bucket in held:
                search_bucket(anchors, bucket, k, same_label)
            for w, (a, score, other, label) in enumerate(anchors.best):
                out.append(pd.DataFrame({"anchor_id": ids[a], "tag": tags[a], "w": w, "id": other, "label": label, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c.split(" ")[0]: [] for c in FOUND.split(", ")})

    return search


def search(anchors: DataFrame, index: DataFrame, seeds, dims: int, k: int, same_label: bool, windows: int, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, tag, w, id, label, score, place) for the first ``k`` rows of each window.

    ``anchors``: id, tag, label, vec and the arrays ``low`` and ``high``, of at most ``windows`` scores each.
    """
    spark = anchors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    packed = materialise(anchors.mapInPandas(_chunked(dims, windows, k, same_label, seeds, chunk), CHUNKS), "anchor-chunks")
    n_chunks, n_buckets = max(packed.count(), 1), max(index.count(), 1)
    h = -(-n_chunks // GROUP_CHUNKS)
    per = min(GROUP_BUCKETS, max(1, n_buckets * h // (2 * cores)))
    g = -(-n_buckets // per)
    # Every chunk meets every bucket: a stated query set against all rows, in groups of bounded size.
    left = packed.withColumn("h", F.pmod(F.xxhash64("chunk"), F.lit(h)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    right = index.withColumn("g", F.pmod(F.xxhash64("bucket"), F.lit(g)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(_group(dims, windows, k, same_label), FOUND)
    order = Window.partitionBy("anchor_id", "tag", "w").orderBy(F.col("score").desc(), "id", "label")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90,
    bucket: int = BUCKET, chunk: int = CHUNK, seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (``quantised``), a row per anchor, positive and negative."""
    rows = materialise(rows, "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dims")).first()
    dims = max(sizes.dims, 1)
    index = build_index(rows, dims, sizes.n, bucket)
    seeds = rows.orderBy(F.xxhash64("id"), "id", "label").limit(seed_rows).collect()  # at most ``seed_rows`` rows
    packed = bucket_row(0, np.array([r.id for r in seeds]), np.array([r.label for r in seeds]), _matrix([r.vec for r in seeds], dims)) if seeds else None
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    tag = F.xxhash64("label", "vec")
    anchors = rows.where(is_anchor).withColumn("tag", tag)
    every = anchors.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(-NONE))})
    best = search(every, index, shared, dims, positives, True, 1, chunk).select(
        "anchor_id", "tag", F.col("place").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    best = materialise(best, "positives")
    # An anchor's windows, one per positive: no more than ``positives`` entries.
    ends = best.groupBy("anchor_id", "tag").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("ps"))
    low = F.transform("ps", lambda x: F.ceil(_share(x["positive_score"], least_percent)).cast("long"))
    high = F.transform("ps", lambda x: F.floor(_share(x["positive_score"], most_percent)).cast("long"))
    asked = anchors.alias("a").join(ends.alias("e"), (F.col("a.id") == F.col("e.anchor_id")) & (F.col("a.tag") == F.col("e.tag")))
    asked = asked.select("a.*", low.alias("low"), high.alias("high"))
    found = search(asked, index, shared, dims, negatives, False, positives, chunk).alias("n")
    same = (F.col("n.anchor_id") == F.col("b.anchor_id")) & (F.col("n.tag") == F.col("b.tag")) & (F.col("n.w") + 1 == F.col("b.p"))
    return found.join(best.alias("b"), same).select(
        "n.anchor_id", "b.positive_id", F.col("n.place").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "b.positive_score", F.col("n.score").alias("negative_score"),
    )


def _share(score: Column, percent: int) -> Column:
    """So many hundredths of a score, exactly."""
    return score.cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")
