"""Mixing sources to target weights by temperature, in DataFrame operations alone.

The token share p of each source is raised to an exponent a in 0..1 and normalised: 1 leaves the
natural mix, 0 makes all sources equal. The exponent is bisected, 32 probes a round, to the largest
with at least the target entropy, or to the smallest at which no source is repeated more than
``most_repeats`` times within the token budget.

The weights are realised as permutations. A source with a quota of q tokens and T tokens of its own
gives q div T whole permutations of its documents and the head of one more that fits the rest. The
order of each permutation is a seeded digest of epoch and id. The stream is cut into blocks of
``block_tokens``; each source fills its weight's share of every block in the order of its
permutations, and rows of a block are ordered by another digest.

Running sums over a source are taken per slice of the digest range and then over the slices, so a
source that holds most rows is spread over many tasks. Whether a document is in the head of the last
permutation follows from its digest and its source's cut, so texts are never shuffled.

Edge cases: a null source is a source of its own; a null or blank text has no tokens and rides along
at no cost; a source without tokens, and an empty table, give nothing; rows repeated with one id tie
and are taken or left together; other columns are carried by ``apply`` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import free_names, materialise

PROBES = 32
ROUNDS = 4
SLICE_ROWS = 4096
SLICE_TOKENS = 1 << 20
#: Sources whose plan is broadcast; beyond it the plan is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: str) -> Column:
    """Words between ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+", "")
    words = F.split(F.concat(F.lit(" "), trimmed), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def digest(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(doc_id).cast("string")).cast("binary"))


def shares(docs: DataFrame, tokens: Column, source: str = "source") -> DataFrame:
    """Per source: n_docs and tokens."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("tokens"))


def find_exponent(stats: DataFrame, budget: int, entropy: float | None = None, most_repeats: float | None = None) -> float:
    """Bisect the exponent; ``entropy`` is a share of the largest possible, log(number of sources)."""
    if (entropy is None) == (most_repeats is None):
        raise ValueError("give either entropy or most_repeats")
    held = stats.where("tokens > 0")
    row = held.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    if not row.n or row.n == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(row.total))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / PROBES
        probes = F.explode(F.array(*[F.lit(low + step * i) for i in range(PROBES + 1)]))
        at = held.select(share.alias("p"), probes.alias("a")).groupBy("a").agg(
            F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("l"),
            F.max(F.pow("p", F.col("a") - 1)).alias("m"),
        ).orderBy("a").collect()
        if entropy is not None:
            good = [r.a for r in at if math.log(r.z) - r.a * r.l / r.z >= entropy * math.log(row.n)]
            low = max(good, default=0.0)
            if low >= 1.0:
                return 1.0
            high = low + step
        else:
            good = [r.a for r in at if r.m / r.z * budget / row.total <= most_repeats]
            high = min(good, default=1.0)
            if high <= 0.0 or not good:
                return high
            low = high - step
    return low if entropy is not None else high


def whole_budget(stats: DataFrame, a: float, total: int, mass: float) -> int:
    """The smallest budget that takes every document of every source at least once."""
    need = F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) * F.lit(mass)))
    return math.ceil(stats.agg(need.alias("b")).first().b or 0)


def plan(
    docs: DataFrame, budget: int | str | None = None, entropy: float | None = None, most_repeats: float | None = None, seed: int = 23,
    doc_id: str = "doc_id", source: str = "source", tokens: Column | None = None, text: str = "text",
) -> DataFrame:
    """Per source: tokens, exponent, weight, quota, epochs (whole permutations) and cut (last digest of the head).

    ``budget`` is in tokens; None stands for the tokens there are, "whole" for the smallest budget
    that takes every document at least once.
    """
    tokens = word_count(text) if tokens is None else tokens
    light = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), tokens.alias("n"))
    light = materialise(light, "tokens")
    stats = materialise(shares(light, F.col("n")), "shares")
    total = stats.agg(F.sum("tokens").alias("t")).first().t or 0
    a = find_exponent(stats, budget if isinstance(budget, int) else total, entropy, most_repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))).otherwise(0.0)
    mass = stats.agg(F.sum(power).alias("z")).first().z or 1.0
    if budget == "whole":
        budget = whole_budget(stats, a, max(total, 1), mass)
    quota = F.round(power / F.lit(mass) * F.lit(float(total if budget is None else budget))).cast("long")
    planned = stats.select("*", F.lit(a).alias("exponent"), (power / F.lit(mass)).alias("weight"), quota.alias("quota")).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(0)
    ).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    planned = materialise(planned, "quotas")

    rows = _with_plan(light, planned, ["epochs", "rest", "n_docs"]).where("rest > 0")
    rows = rows.withColumn("d", digest(seed, F.col("epochs"), "id"))
    part = F.conv(F.substring("d", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("slice", F.floor(part * F.ceil(F.col("n_docs") / SLICE_ROWS)))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("source", "slice", "rest").agg(F.sum("n").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # The head ends in the last slice that begins within the rest.
    last = slices.where("base <= rest").groupBy("source").agg(F.max("slice").alias("slice"))
    last = last.join(slices.select(F.col("source").alias("s"), F.col("slice").alias("sl"), "base"), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).select("source", "slice", "base")
    if last.count() <= BROADCAST_SOURCES:
        last = F.broadcast(last)
    edge = rows.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.slice") == F.col("l.slice")))
    running = Window.partitionBy("r.source").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = edge.withColumn("end", F.col("base") + F.sum("n").over(running)).where(F.col("end") <= F.col("rest"))
    cuts = within.groupBy(F.col("r.source").alias("s")).agg(F.max("d").alias("inside"))
    # Without a row of that slice in the head, the head ends before the slice: its first digest is out.
    firsts = edge.groupBy(F.col("r.source").alias("s2")).agg(F.min("d").alias("first"))
    cuts = firsts.join(cuts, F.col("s2").eqNullSafe(F.col("s")), "left").select(
        F.col("s2").alias("s"), F.col("inside").isNotNull().alias("closed"), F.coalesce("inside", "first").alias("cut")
    )
    return materialise(
        planned.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest", "n_docs"), "plan"
    )


def _with_plan(rows: DataFrame, planned: DataFrame, columns: list[str]) -> DataFrame:
    """Rows joined to the plan of their ``source``."""
    right = planned.select(F.col("source").alias("_s"), *columns)
    if planned.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def apply(docs: DataFrame, planned: DataFrame, seed: int = 23, doc_id: str = "doc_id", source: str = "source", epoch: str = "epoch") -> DataFrame:
    """``docs`` with a row per copy in the mix and its ``epoch``; texts stay where they are.

    A column of ``docs`` that is called like ``epoch`` is replaced by it.
    """
    docs = docs.drop(epoch)
    s, e, cut, closed = free_names(docs, "_s", "_e", "_cut", "_closed")
    right = planned.select(F.col("source").alias(s), F.col("epochs").alias(e), F.col("cut").alias(cut), F.col("closed").alias(closed))
    if planned.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    joined = docs.join(right, F.col(source).eqNullSafe(F.col(s)))
    d = digest(seed, F.col(e), doc_id)
    head = F.coalesce(F.when(F.col(closed), d <= F.col(cut)).otherwise(d < F.col(cut)), F.lit(False))
    copies = (F.col(e) + head.cast("long")).cast("int")
    times = F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")))
    return joined.select(*[f"`{c}`" for c in docs.columns], times.alias(epoch))


def blocks(
    mixed: DataFrame, planned: DataFrame, block_tokens: int, seed: int = 23, doc_id: str = "doc_id", source: str = "source",
    tokens: str = "n_tokens", epoch: str = "epoch",
) -> DataFrame:
    """Per copy: doc_id, source, epoch, n_tokens, start (tokens of its source's stream before it), block and order."""
    rows = mixed.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(epoch).alias("epoch"), F.col(tokens).alias("n_tokens")
    )
    rows = _with_plan(rows, planned, [F.col("tokens").alias("_t"), F.col("weight").alias("_w")])
    rows = rows.withColumn("d", digest(seed, F.col("epoch"), "doc_id"))
    part = F.conv(F.substring("d", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("slice", F.floor(part * F.ceil(F.col("_t") / float(SLICE_TOKENS))))
    keys = ["source", "epoch", "slice"]
    before = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0)))
    bases = bases.select(*[F.col(k).alias(f"b_{k}") for k in keys], "base")
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("slice") == F.col("b_slice"))
    running = Window.partitionBy(*keys).orderBy("d", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).join(bases, same)
    start = F.col("epoch") * F.col("_t") + F.col("base") + F.col("inner")
    return rows.select("doc_id", "source", "epoch", "n_tokens", start.alias("start"), "_w").select(
        "doc_id", "source", "epoch", "n_tokens", "start",
        F.floor(F.col("start") / (F.col("_w") * F.lit(float(block_tokens)))).alias("block"),
        F.md5(F.concat_ws(":", F.lit(str(seed + 1)), "epoch", "doc_id").cast("binary")).alias("order"),
    )
