"""Benchmark decontamination by SimHash windows, in DataFrame operations alone.

1. Texts and items become words (lower case, runs of letters and digits) and shingles of ``words``
   words. A shingle of the benchmark weighs 1 / (1 + ln(1 + n)), n being how often it occurs in all
   documents; any other weighs as if it occurred once.
2. Similarity of an item with a window is the weight of the item's shingles found in the window over
   the weight of all its shingles. A document holding less than ``threshold`` of an item's weight
   anywhere cannot hold such a window, so its places are not looked at further; the others give the
   places where a window of the item's size may begin (the shingle's place less its place in the item).
3. These windows and the items get SimHash fingerprints in which every shingle counts 1, so that passages
   which many documents share weigh no less than the words an edit brings in. A multi-index proposes the items
   near a window: two fingerprints that differ in at most R of 64 bits differ in at most R // 8 bits of one of
   their 8 bytes, so items are indexed under every byte value within that distance. R follows from ``threshold``.
4. For what is proposed, every window is measured exactly, over the distinct shingles it shares with the item. A
   window that begins with a foreign shingle holds no more than the one that begins at its first shared shingle,
   so the places of shared shingles and the aligned places of step 2 are all the beginnings there are.
5. No radius guarantees a similarity for certain, so that the documents and items of step 2 which the index does
   not propose are measured in the same way. Nothing is lost by the index.
6. The best window of each document and item is reported if it reaches ``threshold``, with the bits in which its
   fingerprint by the weights of step 1 differs from the item's. A caller may ask for matches within ``radius`` of
   those bits only, found by the same index; this drops edited copies of passages that many documents share.

The benchmark is a small table; its shingles and index are broadcast only up to ``BROADCAST_ROWS``
rows and otherwise joined by a shuffle, as are the places.

Edge cases: null or empty texts and items hold nothing and match nothing; an item shorter than
``words`` words is one shingle; ties between windows go to the first; repeated rows and copies are
each reported; null doc_ids are reported as null, and ``drop_contaminated`` keeps such rows unless
they match, by their text; an empty table on either side gives no match; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise

WORDS = 3
THRESHOLD = 0.8
RADIUS = 24
BLOCKS = 8
BROADCAST_ROWS = 500_000


def word_list(text: str) -> Column:
    cleaned = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def with_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and ``w``, the hashes of the words of ``text``.

    The words pass through a generator, which the optimizer does not copy into every expression
    that mentions them; the outer form also spares a filter that would compute them once more.
    """
    once = F.inline_outer(F.transform(F.array(word_list(text)), lambda ws: F.struct(F.transform(ws, lambda w: F.xxhash64(w)).alias("w"))))
    return df.select(*keep, once)


def shingles(words: str, k: int, shorter: bool) -> Column:
    """Hashes of all windows of k hashed words, in order; if ``shorter``, a list below k words is one window."""
    hashed, n = F.col(words), F.size(words)
    rest = [F.slice(hashed, F.lit(i + 1), F.greatest(n - k + 1, F.lit(0))) for i in range(k)]
    rolled = rest[0]
    for part in rest[1:]:
        rolled = F.zip_with(rolled, part, lambda a, b: F.xxhash64(a, b))
    if not shorter:
        return F.when(n >= k, rolled).otherwise(F.array().cast("array<bigint>"))
    one = F.aggregate(F.slice(hashed, 2, 1 << 20), F.element_at(hashed, 1), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= k, rolled).when(n > 0, F.array(one)).otherwise(F.array().cast("array<bigint>"))


def bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def weight(times: Column) -> Column:
    return 1 / (1 + F.log1p(times.cast("double")))


def fingerprint(rows: DataFrame, keys: list[str], hashed: str, heavy: str) -> DataFrame:
    """SimHash per key from rows of (keys, hash, weight): one aggregate of 64 signed sums."""
    bit = [F.sum(F.when(F.col(hashed).bitwiseAND(F.lit(1 << i if i < 63 else -(1 << 63))) != 0, F.col(heavy)).otherwise(-F.col(heavy))) for i in range(64)]
    sums = rows.groupBy(*keys).agg(*[b.alias(f"b{i}") for i, b in enumerate(bit)])
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, value.alias("print"))


def byte_of(column: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(column), 8 * i).bitwiseAND(F.lit(255)).cast("int")


def radius_for(threshold: float) -> int:
    """Bits of 64 in which windows of this similarity may differ: the mean of random hyperplanes and 3.5 deviations."""
    share = acos(min(1.0, max(0.0, threshold))) / pi
    return min(63, int(64 * share + 3.5 * sqrt(64 * share * (1 - share))))


def near_bytes(distance: int) -> list[int]:
    """The masks of one byte with at most ``distance`` bits."""
    return sorted(sum(1 << b for b in bits) for d in range(distance + 1) for bits in combinations(range(8), d))


def within_radius(window_prints: DataFrame, item_prints: DataFrame, key: list[str], radius: int) -> DataFrame:
    """The windows (``key``) and items of one size whose fingerprints differ in at most ``radius`` bits."""
    masks = F.array(*[F.lit(m) for m in near_bytes(radius // BLOCKS)])
    index = item_prints.select(
        "item_id", "size", F.col("print").alias("item_print"),
        F.posexplode(F.array(*[byte_of("print", i) for i in range(BLOCKS)])).alias("block", "byte"),
    ).select("item_id", "size", "item_print", "block", F.explode(F.transform(masks, lambda m: F.col("byte").bitwiseXOR(m))).alias("byte"))
    index = materialise(index, "item-index")
    probes = window_prints.select("*", F.posexplode(F.array(*[byte_of("print", i) for i in range(BLOCKS)])).alias("block", "byte"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    return probes.join(bounded(index), ["size", "block", "byte"]).where(apart <= radius).select(*key, "item_id").distinct()


WINDOW = ["doc_id", "row_hash", "start", "size"]


def window_shingles(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The distinct shingles ``h`` of the ``wanted`` windows, read again from the texts."""
    windows = materialise(wanted.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("start", "size")).alias("wanted")), "windows")
    same_row = F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("s.row_hash") == F.col("r.row_hash"))
    worded = with_words(source.alias("s").join(bounded(windows).alias("r"), same_row), "s.text", "s.doc_id", "s.row_hash", "wanted")
    cut = F.transform("wanted", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.slice("w", x["start"] + 1, x["size"]).alias("w")))
    cut = worded.select("doc_id", "row_hash", F.explode(cut).alias("x")).select("doc_id", "row_hash", "x.*")
    return cut.select(*WINDOW, F.explode(F.array_distinct(shingles("w", words, True))).alias("h")).distinct()


def proposed(source: DataFrame, located: DataFrame, item_shingles: DataFrame, words: int, radius: int) -> DataFrame:
    """The rows and items (doc_id, row_hash, item_id) of which the multi-index finds a window within ``radius`` bits."""
    starts = located.select("doc_id", "row_hash", F.greatest(F.col("place") - F.col("at"), F.lit(0)).alias("start"), "size").distinct()
    parts = window_shingles(source, starts, words).withColumn("one", F.lit(1))
    own = item_shingles.select("item_id", "size", "h").distinct().withColumn("one", F.lit(1))
    prints = materialise(fingerprint(parts, WINDOW, "h", "one"), "window-prints")
    return within_radius(prints, fingerprint(own, ["item_id", "size"], "h", "one"), WINDOW, radius).select("doc_id", "row_hash", "item_id").distinct()


def best_windows(located: DataFrame, words: int, threshold: float) -> DataFrame:
    """Per row and item the most similar window of the item's size, the first of equals, if it reaches ``threshold``.

    ``located`` has a row per place of a shared shingle and its place ``at`` in the item. Windows and shingles are
    gathered by blocks of the item's size, so that a document that repeats a passage is no larger group than another.
    """
    size, place = F.col("size"), F.col("place")
    spot = F.struct("place", "h", "weight")
    begins, spots = F.lit(None).cast("int"), F.lit(None).cast("struct<place:int,h:bigint,weight:double>")

    def entry(block, start, spot):
        return F.struct(F.floor(block).alias("block"), start.alias("start"), spot.alias("spot"))

    aligned = F.greatest(place - F.col("at"), F.lit(0))
    entries = F.array(
        entry(aligned / size, aligned, spots), entry(place / size, place, spots),
        # A window reaches into the block after the one it begins in.
        entry(place / size, begins, spot), entry(place / size - 1, begins, spot),
    )
    row = ["doc_id", "row_hash", "item_id"]
    blocks = (
        located.select(*row, "size", "whole", F.inline(entries)).groupBy(*row, "block", "size", "whole")
        .agg(F.collect_set("start").alias("starts"), F.collect_set("spot").alias("spots"))
    )

    def similarity(start: Column) -> Column:
        inside = F.filter("spots", lambda x: (x["place"] >= start) & (x["place"] <= start + size - F.least(size, F.lit(words))))
        shared = F.array_distinct(F.transform(inside, lambda x: F.struct(x["h"].alias("h"), x["weight"].alias("weight"))))
        return F.aggregate(shared, F.lit(0.0), lambda total, x: total + x["weight"]) / F.col("whole")

    measured = F.transform("starts", lambda s: F.struct(F.round(similarity(s), 9).alias("similarity"), (-s).alias("before")))
    best = blocks.where(F.size("starts") > 0).select(*row, "size", F.array_max(measured).alias("b")).where(F.col("b.similarity") >= threshold - 1e-9)
    return best.groupBy(*row, "size").agg(F.max("b").alias("b")).select(*row, "size", (-F.col("b.before")).alias("start"), "b.similarity")


def find_matches(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, radius: int | None = None,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per contaminated row and item: doc_id, row_hash (of the text), item_id, start (word), bits apart, similarity."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = with_words(items, "text", "item_id").where("size(w) > 0")
    items = items.withColumn("size", F.size("w"))
    item_shingles = materialise(
        items.select("item_id", "size", F.posexplode(shingles("w", words, True)).alias("place", "h")), "item-shingles"
    )
    listed = item_shingles.select("h").distinct()

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    worded = with_words(source, "text", "doc_id", "row_hash")
    # Items below ``words`` words are one shingle of their own length, which texts must be cut into as well.
    lengths = [r.n for r in items.select(F.least("size", F.lit(words)).alias("n")).distinct().collect()]
    hashes = [F.transform(shingles("w", n, False), lambda h, i: F.struct(i.alias("place"), h.alias("h"))) for n in sorted(lengths)]
    places = worded.select("doc_id", "row_hash", F.explode_outer(F.flatten(F.array(*hashes)) if hashes else F.array().cast("array<struct<place:int,h:bigint>>")).alias("s"))
    hits = materialise(
        places.select("doc_id", "row_hash", "s.place", "s.h").join(bounded(listed), "h"), "benchmark-places"
    )
    times = hits.groupBy("h").agg(F.count("*").alias("n"))
    weights = materialise(
        listed.join(times, "h", "left").select("h", weight(F.coalesce("n", F.lit(0))).alias("weight")), "shingle-weights"
    )
    distinct = item_shingles.select("item_id", "h").distinct().join(weights, "h")
    whole = distinct.groupBy("item_id").agg(F.sum("weight").alias("whole"))
    heavy = materialise(item_shingles.join(distinct, ["item_id", "h"]).join(whole, "item_id"), "item-weights")

    once = hits.select("doc_id", "row_hash", "h").distinct()
    needed = bounded(heavy.groupBy("item_id", "h", "weight", "whole").agg(F.first("size").alias("size")))
    held = once.join(needed, "h").groupBy("doc_id", "row_hash", "item_id", "whole").agg(F.sum("weight").alias("held"))
    likely = held.where(F.col("held") >= F.col("whole") * (threshold - 1e-9)).select("doc_id", "row_hash", "item_id")
    same_row = F.col("l.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("l.row_hash") == F.col("p.row_hash"))
    located = (
        hits.alias("p").join(likely.alias("l"), same_row).select("p.*", "l.item_id")
        .join(heavy.select("item_id", "h", "size", "weight", "whole", F.col("place").alias("at")), ["item_id", "h"])
    )
    located = materialise(located, "located")
    near = materialise(proposed(source, located, item_shingles, words, radius_for(threshold)), "proposed").alias("n")
    same_pair = F.col("p.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("p.row_hash") == F.col("n.row_hash")) & (F.col("p.item_id") == F.col("n.item_id"))
    verified = best_windows(located.alias("p").join(near, same_pair, "left_semi"), words, threshold)
    others = best_windows(located.alias("p").join(near, same_pair, "left_anti"), words, threshold)
    best = materialise(verified.unionByName(others), "best-windows")
    parts = window_shingles(source, best, words)
    parts = materialise(
        parts.join(bounded(weights), "h", "left").withColumn("weight", F.coalesce("weight", weight(F.lit(1)))), "window-shingles"
    )

    window_prints = fingerprint(parts, WINDOW, "h", "weight")
    item_prints = fingerprint(heavy.select("item_id", "size", "h", "weight").distinct(), ["item_id", "size"], "h", "weight")
    if radius is not None:
        best = best.alias("n").join(
            within_radius(window_prints, item_prints, WINDOW, radius).alias("p"),
            F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("n.row_hash") == F.col("p.row_hash")) & (F.col("n.start") == F.col("p.start")) & (F.col("n.item_id") == F.col("p.item_id")), "left_semi",
        )
    same_window = F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("n.row_hash") == F.col("p.row_hash")) & (F.col("n.start") == F.col("p.start")) & (F.col("n.size") == F.col("p.size"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    return materialise(
        best.alias("n").join(window_prints.alias("p"), same_window).select("n.*", "p.print")
        .join(bounded(item_prints.select("item_id", F.col("print").alias("item_print"))), "item_id")
        .select("doc_id", "row_hash", "item_id", "start", apart.cast("int").alias("bits"), "similarity"), "matches",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents that match no item; same columns."""
    bad = find_matches(docs, benchmark, doc_id=doc_id, text=text, **options)
    bad = bounded(materialise(bad.select(F.col("doc_id").alias("_bad_id"), F.col("row_hash").alias("_bad_hash")).distinct(), "contaminated"))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text]) == bad["_bad_hash"]), "left_anti")
