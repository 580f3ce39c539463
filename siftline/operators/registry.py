"""Registries of posts seen and of models trained.

A registry is kept as two append-only tables: entries, and sightings of entries. Each
batch writes its own partition of both and overwrites it when it is replayed, so a lost
executor or a restarted stream never counts a post twice. Posts are looked up in a kept
index (``textindex``), of which a batch reads the partitions of its own tokens. The
registry as it stands is entries plus summed sightings.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from siftline.functions import text as X
from siftline.operators import similarity as S
from siftline.operators.components import components
from siftline.operators.ranking import first_per_group
from siftline.operators.textindex import TextIndex
from siftline.schemas import MODEL_REGISTRY, PROBLEM_REGISTRY
from siftline.session import cut, kept

# Helpers travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENT_LINKS = 200_000
BATCH_STRIDE = 2**40  # registry_seq = batch * stride + position in the batch
ENTRY = T.StructType(
    [f for f in PROBLEM_REGISTRY.fields if f.name not in ("last_seen", "seen_count", "task_types")] + [T.StructField("batch", T.LongType())]
)
SIGHTING = (
    T.StructType().add("registry_seq", "long").add("dataset_id", "string").add("task_type", "string")
    .add("n", "long").add("first_seq", "long").add("seen_at", "timestamp").add("batch", "long")
)


def empty_registry(spark: SparkSession, kind: str = "problem") -> DataFrame:
    return spark.createDataFrame([], PROBLEM_REGISTRY if kind == "problem" else MODEL_REGISTRY)


def read_registry(spark: SparkSession, path: str, kind: str = "problem") -> DataFrame:
    """A registry table, empty when there is none yet."""
    schema = PROBLEM_REGISTRY if kind == "problem" else MODEL_REGISTRY
    return _read(spark, path, schema)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# -- the first of similar posts ---------------------------------------------


def _greedy(links: pd.DataFrame) -> pd.DataFrame:
    """The dropped texts of one component, taken one by one in order of ``rfirst``."""
    dropped, kept = [], set()
    links = links.sort_values(["rfirst", "rk"])
    starts = set(links["lk"]) - set(links["rk"])
    kept |= starts
    for rk, own in links.groupby("rk", sort=False):
        if kept.isdisjoint(own["lk"]):
            kept.add(rk)
        else:
            dropped.append(rk)
    return pd.DataFrame({"k": pd.Series(dropped, dtype=object)})


def leaders(sets: DataFrame, pairs: DataFrame, rounds: int = 2, most: int = COMPONENT_LINKS) -> DataFrame:
    """(k): texts that no earlier kept text resembles, as when posts are taken one by one.

    ``sets``: (k, first); ``pairs``: similar (lk, rk) with lk earlier. A text is kept once all
    earlier similar ones are dropped, and dropped once one of them is kept. A round settles every
    text whose earlier ones are settled, and only the links between open texts go on. After a few
    rounds the connected components that are left are settled in one task each, where they have
    ``most`` links or fewer; only larger ones need more rounds.
    """
    order = sets.select(F.col("k").alias("rk"), F.col("first").alias("rfirst"))
    open_ = cut(pairs.select("lk", "rk").distinct().join(order, "rk"))
    dropped, done = [], 0
    while not open_.isEmpty():
        if done == rounds:
            of = components(open_, "lk", "rk").select(F.col("node").alias("rk"), "root")
            placed = cut(open_.join(of, "rk"))
            small = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("root")
            within = placed.join(small, "root", "left_semi")
            dropped.append(cut(within.select("root", "lk", "rk", "rfirst").groupBy("root").applyInPandas(_greedy, "k string")))
            open_ = cut(placed.join(small, "root", "left_anti").drop("root"))
            done += 1
            continue
        first = open_.select(F.col("lk").alias("k")).distinct().join(open_.select(F.col("rk").alias("k")).distinct(), "k", "left_anti")
        gone = cut(open_.join(first, F.col("lk") == F.col("k"), "left_semi").select(F.col("rk").alias("k")).distinct())
        dropped.append(gone)
        rest = open_.join(gone, F.col("rk") == F.col("k"), "left_anti")
        open_ = cut(rest.join(gone, F.col("lk") == F.col("k"), "left_anti"))
        done += 1
    kept = sets.select("k")
    for gone in dropped:
        kept = kept.join(gone, "k", "left_anti")
    return kept


def group_batch(df: DataFrame, threshold: float = 0.90, ident: str = "seq", text: str = "signature",
                boost: bool = True) -> DataFrame:
    """(seq, leader, similarity): every post with the kept post it repeats, or with itself."""
    members, sets = S._distinct_texts(df, ident, text, 1.0)
    sims = kept(S.similar_texts(sets, sets, threshold, boost, earlier=True), "similar-posts")
    stay = leaders(sets, sims)
    follow = sims.join(stay.withColumnRenamed("k", "lk"), "lk", "left_semi").join(
        stay.withColumnRenamed("k", "rk"), "rk", "left_anti")
    best = follow.groupBy(F.col("rk").alias("k")).agg(F.max(F.struct("similarity", (-F.col("l_first")).alias("neg"))).alias("b"))
    assigned = sets.select("k", "first").join(best, "k", "left").select(
        "k", F.coalesce(-F.col("b.neg"), "first").alias("leader"), F.coalesce("b.similarity", F.lit(1.0)).alias("similarity"))
    return members.join(assigned, "k").select(F.col("id").alias(ident), "leader", "similarity")


# -- problem registry -------------------------------------------------------


class ProblemRegistry:
    """Posts seen, under ``path``; ``register`` is idempotent per batch id."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.90):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.index = TextIndex(spark, f"{self.path}/index", threshold, self.entries)

    def entries(self, before: int | None = None) -> DataFrame:
        df = _read(self.spark, f"{self.path}/entries", ENTRY)
        return df if before is None else df.where(F.col("batch") < before)

    def sightings(self, before: int | None = None) -> DataFrame:
        df = _read(self.spark, f"{self.path}/sightings", SIGHTING)
        return df if before is None else df.where(F.col("batch") < before)

    def current(self) -> DataFrame:
        """The registry as it stands."""
        s, e = self.sightings(), self.entries().drop("batch")
        seen = s.groupBy("registry_seq").agg(F.sum("n").alias("n"), F.max("seen_at").alias("at"))

        def collected(col: str) -> DataFrame:
            # Distinct values per entry first, so a hot entry carries few of them.
            once = s.where(F.col(col).isNotNull()).groupBy("registry_seq", col).agg(F.min(F.struct("batch", "first_seq")).alias("o"))
            return once.groupBy("registry_seq").agg(
                F.transform(F.sort_array(F.collect_list(F.struct("o", col))), lambda x: x[col]).alias(f"_{col}"))

        none = F.array().cast("array<string>")
        j = e.join(seen, "registry_seq", "left").join(collected("dataset_id"), "registry_seq", "left").join(
            collected("task_type"), "registry_seq", "left")
        own_task = F.when(F.col("task_type").isNotNull(), F.array("task_type")).otherwise(none)
        return j.withColumns(
            {
                "datasets_used": F.array_union(F.coalesce("datasets_used", none), F.coalesce("_dataset_id", none)),
                "task_types": F.array_union(own_task, F.coalesce("_task_type", none)),
                "last_seen": F.greatest("first_seen", "at"),
                "seen_count": F.lit(1) + F.coalesce("n", F.lit(0)),
            }
        ).select(*[f.name for f in PROBLEM_REGISTRY.fields])

    def check(self, df: DataFrame, ident: str = "seq", before: int | None = None) -> DataFrame:
        """(seq, registry_seq, similarity) of posts that are registered already, before a batch or at all."""
        if before is None:
            last = self.entries().agg(F.max("batch")).first()[0]
            before = 0 if last is None else last + 1
        return self.index.best_match(df, before, ident)

    def register(self, posts: DataFrame, batch: int, now: Column | None = None) -> None:
        """Register a batch. ``posts``: seq, title, description, source, url, task_type, dataset_id.

        A post that resembles an entry, or an earlier kept post of the batch, is a sighting
        of the most similar one.
        """
        now = F.current_timestamp() if now is None else now
        p = kept(posts.withColumn("signature", X.problem_signature("title", "description")).withColumn("_now", now), "posts")
        known = cut(self.check(p, before=batch))
        fresh = p.join(known, "seq", "left_anti")
        grouped = cut(group_batch(fresh, self.threshold))
        new = p.join(grouped.where(F.col("seq") == F.col("leader")), "seq", "left_semi")
        number = F.lit(batch * BATCH_STRIDE) + F.col("seq")
        entries = new.select(
            number.alias("registry_seq"), "signature",
            F.struct("title", "description", F.coalesce("source", F.lit("unknown")).alias("source"), "url").alias("problem"),
            "task_type",
            F.when(X.filled("dataset_id").isNotNull(), F.array("dataset_id")).otherwise(F.array().cast("array<string>")).alias("datasets_used"),
            F.col("_now").alias("first_seen"),
        )
        # A post known from before may be closer to an entry added by an earlier post of this batch.
        added = new.select(F.col("seq").alias("registry_seq"), "signature")
        again = p.join(known, "seq", "left_semi")
        closer = self._earlier_and_closer(again, added, known)
        to_new = grouped.where(F.col("seq") != F.col("leader")).select("seq", (F.lit(batch * BATCH_STRIDE) + F.col("leader")).alias("registry_seq"))
        to_old = known.join(closer, "seq", "left_anti").select("seq", "registry_seq")
        moved = closer.select("seq", (F.lit(batch * BATCH_STRIDE) + F.col("registry_seq")).alias("registry_seq"))
        hits = to_new.unionByName(to_old).unionByName(moved).join(p, "seq")
        sightings = hits.groupBy("registry_seq", "dataset_id", "task_type").agg(
            F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("_now").alias("seen_at"))
        entries = kept(entries, "entries")
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/batch={batch}")
        self.index.add(batch, entries)
        sightings.write.mode("overwrite").parquet(f"{self.path}/sightings/batch={batch}")

    def _earlier_and_closer(self, again: DataFrame, added: DataFrame, known: DataFrame) -> DataFrame:
        members, qs = S._distinct_texts(again, "seq", "signature", 1.0)
        _, rs = S._distinct_texts(added, "registry_seq", "signature", 1.0)
        sims = S.similar_texts(qs, rs, self.threshold)
        pairs = members.join(sims, F.col("k") == F.col("lk")).where(F.col("r_first") < F.col("id"))
        best = pairs.groupBy(F.col("id").alias("seq")).agg(F.max(F.struct("similarity", (-F.col("r_first")).alias("neg"))).alias("b"))
        return (
            best.join(known.select("seq", F.col("similarity").alias("_old")), "seq").where(F.col("b.similarity") > F.col("_old"))
            .select("seq", (-F.col("b.neg")).alias("registry_seq"))
        )


# -- model registry ---------------------------------------------------------


def check_models(runs: DataFrame, registry: DataFrame, threshold: float = 0.85, limit: int = 2, ident: str = "id") -> DataFrame:
    """(id, registry_seq, similarity, train_count, blocked): nearest trained model of each planned run."""
    m = S.best_match(runs, registry, threshold, query=ident, boost=False, both_empty=0.0)
    j = m.join(registry.select("registry_seq", "train_count"), "registry_seq")
    return j.withColumn("blocked", F.col("train_count") >= limit)


def allowed_runs(runs: DataFrame, checked: DataFrame, ident: str = "id") -> DataFrame:
    return runs.join(checked.where("blocked"), ident, "left_anti")


ADMITTED = "seq long, admitted boolean, similar string, similarity double"


class _Group:
    """Entries of one group of similar signatures, and who resembles whom."""

    def __init__(self):
        self.near: dict[str, list[tuple[str, float]]] = {}
        self.entries: dict[str, list] = {}  # signature: [place, times trained]
        self.first: dict[str, str] = {}  # text: its first signature

    def enter(self, k: str, signature: str, n: int) -> None:
        self.entries[signature] = [len(self.entries), n]
        self.first.setdefault(k, signature)

    def decide(self, k: str, signature: str, limit: int) -> tuple[bool, str | None, float | None]:
        """Is the run taken? By the entry most similar to it, the first one among equals."""
        best = None
        for other, sim in [(k, 1.0), *self.near.get(k, [])]:
            if other in self.first:
                name = self.first[other]
                rank = (-sim, self.entries[name][0])
                if best is None or rank < best[0]:
                    best = (rank, name, sim)
        if best is not None and self.entries[best[1]][1] >= limit:
            return False, best[1], best[2]
        if signature in self.entries:
            self.entries[signature][1] += 1
        else:
            self.enter(k, signature, 1)
        return True, *(best[1:] if best else (None, None))


def _decide(limit: int):
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs in order, group by group; a group's signatures are held, not its runs."""
        root, group = None, _Group()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.root != root:
                    root, group = r.root, _Group()
                if r.kind == 0:
                    group.near.setdefault(r.k, []).append((r.other, r.similarity))
                elif r.kind == 1:
                    group.enter(r.k, r.signature, int(r.n))
                else:
                    out.append((int(r.seq), *group.decide(r.k, r.signature, limit)))
            if out:
                yield pd.DataFrame(out, columns=["seq", "admitted", "similar", "similarity"])

    return decide


def admit_runs(registry: DataFrame, runs: DataFrame, threshold: float = 0.85, limit: int = 2) -> DataFrame:
    """(seq, admitted, similar, similarity): each run in order, as if registered one by one.

    A run is refused if the entry most similar to it, at or above the threshold, has been trained
    ``limit`` times; else it counts for its own signature, a new entry if there is none.

    Signatures are grouped by similarity; groups are dealt out and their runs pass in order by a state
    of one count per signature. Of a streak of runs of one signature without another one of the group in
    between, only the first ``limit + 1`` are looked at: the others are decided like the last of these.
    """
    runs = runs.select("seq", "signature")
    every = registry.select(F.col("registry_seq").alias("seq"), "signature").unionByName(runs)
    members, sets = S._distinct_texts(every.select("signature").distinct(), "signature", "signature", 0.0)
    near = cut(S.similar_texts(sets, sets, threshold, boost=False, earlier=True).select("lk", "rk", "similarity"))
    of = components(near, "lk", "rk")
    texts = members.select(F.col("id").alias("signature"), "k").join(of.withColumnRenamed("node", "k"), "k", "left")
    texts = cut(texts.withColumn("root", F.coalesce("root", "k")))
    none = {"string": F.lit(None).cast("string"), "double": F.lit(None).cast("double"), "long": F.lit(0).cast("long")}
    both = near.unionByName(near.select(F.col("rk").alias("lk"), F.col("lk").alias("rk"), "similarity"))
    links = both.join(of, F.col("lk") == F.col("node")).select(
        "root", F.lit(0).alias("kind"), none["long"].alias("seq"), F.col("lk").alias("k"), F.col("rk").alias("other"), "similarity",
        none["string"].alias("signature"), none["long"].alias("n"))

    def events(df: DataFrame, kind: int, n) -> DataFrame:
        return df.join(texts, "signature").select(
            "root", F.lit(kind).alias("kind"), "seq", "k", none["string"].alias("other"), none["double"].alias("similarity"), "signature", n.alias("n"))

    had = events(registry.select(F.col("registry_seq").alias("seq"), "signature", F.col("train_count").cast("long").alias("count")), 1, F.col("count"))
    w = Window.partitionBy("root").orderBy("seq")
    run = events(runs, 2, none["long"])
    # The place within a streak: runs of the group so far less runs of the signature so far stay equal in it.
    lead = run.withColumn("_streak", F.row_number().over(w) - F.row_number().over(Window.partitionBy("root", "signature").orderBy("seq")))
    lead = lead.withColumn("_at", F.row_number().over(Window.partitionBy("root", "signature", "_streak").orderBy("seq")))
    lead = cut(lead)
    looked = lead.where(F.col("_at") <= limit + 1).drop("_streak", "_at")
    stream = links.unionByName(had).unionByName(looked)
    decided = cut(stream.repartition("root").sortWithinPartitions("root", "kind", "seq").mapInPandas(_decide(limit), ADMITTED))
    last = lead.where(F.col("_at") == limit + 1).select("seq", "root", "signature", "_streak").join(decided, "seq").select("root", "signature", "_streak", "admitted", "similar", "similarity")
    more = lead.where(F.col("_at") > limit + 1).select("seq", "root", "signature", "_streak").join(last, ["root", "signature", "_streak"])
    return decided.unionByName(more.select("seq", "admitted", "similar", "similarity"))


def refused_models(registry: DataFrame, runs: DataFrame, limit: int = 2) -> DataFrame:
    """The runs that ``register_models`` does not take, as their signature has ``limit`` already."""
    return runs.join(_with_room(registry, runs, limit).select("signature", "seq"), ["signature", "seq"], "left_anti")


def _with_room(registry: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    room = runs.join(registry.select("signature", F.col("train_count").alias("_had")), "signature", "left")
    room = first_per_group(room, ["signature"], ["seq"], limit)
    room = room.withColumn("_r", F.row_number().over(Window.partitionBy("signature").orderBy("seq"))).where(F.coalesce("_had", F.lit(0)) + F.col("_r") <= limit)
    return room


def register_models(registry: DataFrame, runs: DataFrame, limit: int = 2, threshold: float | None = None) -> DataFrame:
    """The registry after the runs: same signature counts up and appends, others are new entries.

    With a ``threshold`` runs similar to an entry at its limit are refused too, run by run (``admit_runs``).

    ``runs``: seq, signature, problem, dataset, task_type, model_path, metrics, trained_at.
    A signature trained ``limit`` times takes no more runs, which bounds its lists; those left
    over are what ``refused_models`` returns.
    """
    if threshold is None:
        room = _with_room(registry, runs, limit)
    else:
        room = runs.join(admit_runs(registry, runs, threshold, limit).where("admitted").select("seq"), "seq", "left_semi")
    new = room.groupBy("signature").agg(
        F.min("seq").alias("_seq"), F.count("*").alias("_n"),
        F.sort_array(F.collect_list(F.struct("seq", "model_path", "metrics", "trained_at"))).alias("_runs"),
        F.min_by("problem", "seq").alias("_problem"), F.min_by("dataset", "seq").alias("_dataset"), F.min_by("task_type", "seq").alias("_task"),
    )
    top = registry.agg(F.coalesce(F.max("registry_seq") + 1, F.lit(0))).scalar()
    j = registry.join(new, "signature", "full_outer")
    paths, mets, times = (F.col("_runs")[c] for c in ("model_path", "metrics", "trained_at"))
    no_path, no_metric = F.array().cast("array<string>"), F.array().cast(MODEL_REGISTRY["metrics"].dataType)
    return j.select(
        F.coalesce("registry_seq", top + F.col("_seq")).alias("registry_seq"), "signature",
        F.coalesce("problem", "_problem").alias("problem"), F.coalesce("dataset", "_dataset").alias("dataset"),
        F.coalesce("task_type", "_task").alias("task_type"),
        (F.coalesce("train_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("train_count"),
        F.coalesce("first_trained", times[0]).alias("first_trained"),
        F.coalesce(F.try_element_at(times, F.lit(-1)), "last_trained").alias("last_trained"),
        F.concat(F.coalesce("model_paths", no_path), F.coalesce(paths, no_path)).alias("model_paths"),
        F.concat(F.coalesce("metrics", no_metric), F.coalesce(mets, no_metric)).alias("metrics"),
    )
