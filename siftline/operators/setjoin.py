"""Exact set-similarity join on token sets.

Two sets with Jaccard similarity t or more share one of their rarest tokens: under any
total order of tokens the first |x| - ceil(t |x|) + 1 tokens of each set are enough to
find every such pair. So only those are joined, on token equality. The order is rarity as
counted in hashed counters: with a bounded table of counts every set is ordered where it
is, without a join or a shuffle, and common words hardly ever take part. There are so many
counters that a rare word seldom shares one with others: with few of them all words but the
most common ones are ordered by chance, and candidates grow with the square of the sets.
Length and position bounds drop most remaining candidates inside the join, and parity bitmaps
of whole sets drop most of the others (``near_bitmaps``); the rest is verified on whole sets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import cut

# Helpers travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = 1e-9
# At most so many hot tokens are broadcast.
HOT = 1000
CHUNK = 50_000
COUNTERS = 1 << 20
SLICE = 512  # sets a task orders at once
BITMAP = 16  # numbers of 64 bits
# Up to so many keys are broadcast.
FEW = 500_000


# -- the order of tokens ----------------------------------------------------


def _rank(count: int) -> int:
    return min(90, 1 + int(3 * math.log2(count + 1)))


def rarity(*sets: DataFrame, counters: int | None = None) -> list[int]:
    """A number per hashed counter, 1 to 90, that grows with the count of its tokens in all ``sets``."""
    counters = counters or COUNTERS
    words = [s.select(F.explode_outer("toks").alias("t")).where("t IS NOT NULL") for s in sets]
    words = reduce(DataFrame.unionByName, words)
    counted = words.groupBy(F.pmod(F.xxhash64("t"), F.lit(counters)).cast("int").alias("c")).count()
    got = counted.select("c", F.least("count", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()  # at most ``counters`` rows
    found = got.column("n").to_numpy()
    table = np.ones(counters, dtype=np.int64)
    kinds, where = np.unique(found, return_inverse=True)
    table[got.column("c").to_numpy()] = np.array([_rank(int(n)) for n in kinds], dtype=np.int64)[where]
    return table.tolist()


def keys(tokens: Column | str, table: Sequence[int]) -> Column:
    """Tokens as (rarity, 56 bits of hash) in one number each, rarest first."""
    # The table as 256 texts of 256 characters: a constant that is cheap to compare and to look into.
    lines = ["".join(chr(32 + x) for x in table[i : i + 256]) for i in range(0, len(table), 256)]
    ranks = F.array(*[F.lit(x) for x in lines])

    def key(token: Column) -> Column:
        h = F.xxhash64(token)
        c = F.pmod(h, F.lit(len(table))).cast("int")
        rank = F.ascii(F.substring(F.get(ranks, F.shiftright(c, 8)), c.bitwiseAND(F.lit(255)) + 1, F.lit(1))) - 32
        return F.shiftleft(rank.cast("bigint"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, key))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the list each one is in."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _ordering(table: np.ndarray, names: list[str], listed: np.ndarray | None):
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                h, row = _flat(b.column("_h"))
                key = (table[h & (len(table) - 1)].astype(np.int64) << 56) | (h & ((1 << 56) - 1))
                key = key[np.lexsort((key, row))]  # the rows stay in order
                starts = np.searchsorted(row, np.arange(b.num_rows))
                pos = np.arange(len(row)) - starts[row]
                keep = pos < b.column("_len").to_numpy(zero_copy_only=False)[row]
                if listed is not None:
                    bit = key & (8 * len(listed) - 1)
                    keep &= (listed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                of = pa.array(row[keep])
                pos += b.column("_out").to_numpy(zero_copy_only=False)[row]
                columns = [b.column(c).take(of) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pos[keep].astype(np.int32)), pa.array(key[keep])], [*names, "pos", "t"])

    return order


def sizes(sets: DataFrame) -> Column:
    """How many tokens a set has; ``n`` where only some of them are still in ``toks`` (``only``)."""
    return F.col("n") if "n" in sets.columns else F.size("toks")


def prefixes(
    sets: DataFrame, table: Sequence[int], threshold: Column, carry: Sequence[str] = (), most: int | None = None, listed: np.ndarray | None = None,
) -> DataFrame:
    """(k, n, carried columns, pos, t): the prefix tokens of each set with their 0-based position.

    ``most``: no more tokens of a set than that; ``listed``: only tokens that are in it (``listing``).
    Tokens that were left out of ``toks`` (``only``) are in no other set, so they come first in the order.
    """
    n, out = sizes(sets), sizes(sets) - F.size("toks")
    length = F.least(F.greatest(n - F.ceil(threshold * n - EPS).cast("int") + 1, F.lit(1)), n) - out
    length = length if most is None else F.least(length, F.lit(most))
    hashed = F.transform("toks", lambda t: F.xxhash64(t))
    rows = sets.select("k", n.alias("n"), *carry, length.alias("_len"), out.alias("_out"), hashed.alias("_h"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in ("_len", "_out", "_h")]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField("t", T.LongType())])
    return rows.mapInArrow(_ordering(np.array(table, dtype=np.int8), [f.name for f in fields], listed), schema)


def listing(rows: DataFrame, size: int = 1 << 24) -> np.ndarray:
    """``size`` bits in which the tokens ``t`` of the rows are marked; others may be, by their hash."""
    marked = np.zeros(size, dtype=bool)
    got = rows.select(F.col("t").bitwiseAND(F.lit(size - 1)).cast("int").alias("b")).distinct().toArrow()  # at most ``size`` numbers
    marked[got.column("b").to_numpy()] = True
    return np.packbits(marked)


def _kept_tokens(listed: np.ndarray, names: list[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                h, row = _flat(b.column("_h"))
                bit = h & (8 * len(listed) - 1)
                held = (listed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                ends = np.bincount(row[held], minlength=b.num_rows).cumsum()
                toks = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), b.column("toks").flatten().filter(pa.array(held)))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], toks], [*names, "toks"])

    return keep


def only(sets: DataFrame, listed: np.ndarray) -> DataFrame:
    """The sets with the ``listed`` tokens alone in ``toks``; ``n`` is the number of all of them."""
    rows = sets.withColumns({"n": F.size("toks"), "_h": F.transform("toks", lambda t: F.xxhash64(t))})
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in ("toks", "_h")]
    schema = T.StructType([*fields, T.StructField("toks", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(_kept_tokens(listed, [f.name for f in fields]), schema)


def common(left: DataFrame, right: DataFrame, size: int = 1 << 24) -> np.ndarray:
    """The ``listing`` of the tokens that are on both sides, and of few others by their hash."""
    left, right = (x.select(F.explode("toks").alias("t")).select(F.xxhash64("t").bitwiseAND(F.lit(size - 1)).alias("t")).distinct() for x in (left, right))
    return listing(left.join(right, "t", "left_semi"), size)


def may_reach(a: str, b: str, threshold: Column) -> Column:
    """Can the sets behind two rows of one prefix token reach the threshold?

    By their sizes, and by the tokens that are left from the shared one on.
    """
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    room = F.least(an - F.col(f"{a}.pos"), bn - F.col(f"{b}.pos"))
    return (bn >= threshold * an - EPS) & (an >= threshold * bn - EPS) & (room >= threshold / (1 + threshold) * (an + bn) - EPS)


# -- candidates -------------------------------------------------------------


def candidates(
    left: DataFrame, right: DataFrame, threshold: float | None = None, carry: Sequence[str] = (), where: str | None = None,
    table: Sequence[int] | None = None,
) -> DataFrame:
    """(lk, rk) pairs among which are all with Jaccard >= threshold, each once.

    ``left`` and ``right``: (k, toks), k unique, toks distinct and not empty. ``left`` may
    carry its own threshold per row in ``thr``; a pair must share a token at any threshold.
    ``where`` is a condition on the columns ``carry`` of both sides, as ``a.x`` and ``b.x``.
    """
    table = table or (rarity(right) if left is right else rarity(left, right))
    left = left if "thr" in left.columns else left.withColumn("thr", F.lit(float(threshold)))
    least = threshold if threshold is not None else left.agg(F.min("thr")).scalar()
    lp = prefixes(left, table, F.col("thr"), ("thr", *carry))
    rp = prefixes(right, table, least if isinstance(least, Column) else F.lit(float(least)), carry)
    if threshold is None:  # few left rows may be asked: right rows of other tokens go nowhere
        rp = rp.join(lp.select("t").distinct(), "t", "left_semi")

    on = (F.col("a.t") == F.col("b.t")) & may_reach("a", "b", F.col("a.thr"))
    if where:
        on = on & F.expr(where)
    hot = _hot(lp, rp, table)
    if hot is not None:
        lp, rp = _in_a_grid(lp, hot, "l"), _in_a_grid(rp, hot, "r")
        on = on & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    return lp.alias("a").join(rp.alias("b"), on).select(F.col("a.k").alias("lk"), F.col("b.k").alias("rk")).distinct()


def within(short: DataFrame, long: DataFrame, threshold: float, table: Sequence[int], where: str | None = None) -> DataFrame:
    """(sk, lk): among them all pairs with Jaccard >= threshold in which the text of ``short`` lies in that of ``long``.

    (k, toks, first, chars) on both sides. All tokens of the short text but its first and its last one, which
    may be cut, are tokens of the long one. So one of its three rarest tokens is shared, and the rarest shared
    one is in the prefix of the long set: few of that prefix are asked for and leave the task.
    """
    few = cut(prefixes(short, table, F.lit(float(threshold)), ("first", "chars"), most=3))
    many = prefixes(long, table, F.lit(float(threshold)), ("first", "chars"), listed=listing(few))
    shared = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.t") == F.col("b.t")) & may_reach("a", "b", F.lit(float(threshold))) & (F.col("a.chars") <= F.col("b.chars"))
    on = on & (shared >= F.col("a.n") - 2)
    on = on if where is None else on & F.expr(where)
    return few.alias("a").join(many.alias("b"), on).select(F.col("a.k").alias("sk"), F.col("b.k").alias("lk")).distinct()


def _hot(lp: DataFrame, rp: DataFrame, table: Sequence[int]) -> DataFrame | None:
    """(t, sl, sr): the tokens with over CHUNK prefix rows on a side, and the chunks each side is cut into.

    A token's rows are no more than the count behind its rarity, so that only frequent tokens are counted.
    """
    frequent = _rank(CHUNK)
    if max(table) < frequent:
        return None
    lp, rp = (x.select("t").where(F.shiftright("t", 56) >= frequent) for x in (lp, rp))
    counts = (
        rp.withColumn("l", F.lit(0)).unionByName(lp.withColumn("l", F.lit(1))).groupBy("t")
        .agg(F.sum("l").alias("fl"), F.sum(1 - F.col("l")).alias("fr"))
    )
    chunks = {f"s{x}": F.ceil(F.col(f"f{x}") / CHUNK).cast("int") for x in "lr"}
    hot = cut(counts.where((F.greatest("fl", "fr") > CHUNK) & (F.least("fl", "fr") > 0)).withColumns(chunks).drop("fl", "fr"))
    n = hot.limit(HOT + 1).count()
    return None if n == 0 else F.broadcast(hot) if n <= HOT else hot


def _in_a_grid(rows: DataFrame, hot: DataFrame, side: str) -> DataFrame:
    """Rows of a hot token cut into chunks, each once for every chunk of the other side."""
    mine, others = (F.coalesce(f"s{x}", F.lit(1)) for x in (side, "r" if side == "l" else "l"))
    dealt = rows.join(hot, "t", "left").withColumn("own", F.pmod(F.xxhash64("k"), mine).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))).drop("sl", "sr")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            h, row = _flat(b.column("_h"))
            bits = np.zeros((b.num_rows, BITMAP), dtype=np.uint64)
            np.bitwise_xor.at(bits, (row, (h >> 26) & (BITMAP - 1)), np.uint64(1) << ((h >> 20) & 63).astype(np.uint64))
            columns = [pa.array(bits[:, i].view(np.int64)) for i in range(BITMAP)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), *columns], ["k", "n", *[f"s{i}" for i in range(BITMAP)]])


def bitmaps(sets: DataFrame) -> DataFrame:
    """(k, n, s0, s1, ...): a bit per hash of a token, set if an odd number of tokens have it."""
    rows = sets.select("k", F.size("toks").alias("n"), F.transform("toks", lambda t: F.xxhash64(t)).alias("_h"))
    words = [T.StructField(f"s{i}", T.LongType()) for i in range(BITMAP)]
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "_h"]
    return rows.mapInArrow(_bitmaps, T.StructType([*fields, *words]))


def near_bitmaps(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, inside: str = "") -> DataFrame:
    """The (lk, rk) whose ``bitmaps`` allow a Jaccard similarity of ``threshold``.

    No more bits differ than there are tokens that are in one set only. ``inside``: the side, "l" or "r",
    whose text lies in the other one, so that all its tokens but two are shared (``within``).
    """
    n = F.col("a.n") + F.col("b.n")
    need = F.ceil(threshold / (1 + threshold) * n - EPS)
    need = F.greatest(need, F.col("a.n" if inside == "l" else "b.n") - 2) if inside else need
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(BITMAP)])
    both = pairs.join(left.alias("a"), F.col("lk") == F.col("a.k")).join(right.alias("b"), F.col("rk") == F.col("b.k"))
    return both.where(apart <= n - 2 * need).select("lk", "rk")


def asked(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets with one of the ``keys`` (k); a few keys are sent to the sets, and no set is moved."""
    keys = cut(keys.distinct())
    return sets.join(F.broadcast(keys) if keys.count() <= FEW else keys, "k", "left_semi")


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add ``jaccard`` from the whole sets, and ``l_``/``r_`` copies of the extra columns."""
    l = left.select(F.col("k").alias("lk"), F.col("toks").alias("lt"), sizes(left).alias("_ln"), *[F.col(c).alias(f"l_{c}") for c in extra])
    r = right.select(F.col("k").alias("rk"), F.col("toks").alias("rt"), sizes(right).alias("_rn"), *[F.col(c).alias(f"r_{c}") for c in extra])
    both = pairs.join(l, "lk").join(r, "rk")
    both = once(both, F.size(F.array_intersect("lt", "rt")), "_shared").withColumn("_union", F.col("_ln") + F.col("_rn") - F.col("_shared"))
    return both.withColumn("jaccard", F.when(F.col("_union") > 0, F.col("_shared") / F.col("_union")).otherwise(0.0)).drop("lt", "rt", "_ln", "_rn", "_shared", "_union")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column that is computed once, however often it is used above.

    Filters and projections above a plain column would each take a copy of its expression, and
    so would the filter that the inner form of a generator is given.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def jaccard(a: Column | str, b: Column | str, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(both_empty)
