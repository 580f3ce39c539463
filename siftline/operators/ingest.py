"""Bring records from several sources to one shape, drop copies and poor rows, rank."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions import vocab as V
from siftline.operators import setjoin as J
from siftline.operators.ranking import first_per_group
from siftline.session import cut


def union_sources(*dfs: DataFrame) -> DataFrame:
    """All rows of all sources; columns a source lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def hash_dedup(
    df: DataFrame,
    title: str = "title",
    description: str = "description",
    order: Sequence[str] = ("seq",),
    prefix: int | None = None,
) -> DataFrame:
    """Keep the first of the posts that share title and description, or its first ``prefix`` characters."""
    hashed = df.withColumn("_hash", X.text_hash(title, description, prefix))
    return first_per_group(hashed, ["_hash"], order).drop("_hash")


def quality_filter(df: DataFrame, min_length: int = 50) -> DataFrame:
    """Long enough, with a title and a description."""
    return df.where(
        (F.length(X.blank("full_text")) >= min_length)
        & X.filled("title").isNotNull()
        & X.filled("description").isNotNull()
    )


def source_order(descending: bool = False) -> list[Column]:
    """Sort keys: kaggle first, then usability and stars.

    Ascending by default, which puts the least usable first; ``descending`` turns it round.
    """
    usability = F.when(F.col("source") == "kaggle", F.coalesce("usability", F.lit(0.0))).otherwise(0.0)
    stars = F.when(F.col("source") == "github", F.coalesce("stars", F.lit(0))).otherwise(0)
    keys = [usability, stars]
    first = F.when(F.col("source") == "kaggle", 0).otherwise(1)
    return [first.asc()] + [k.desc() if descending else k.asc() for k in keys]


def rank_problems(df: DataFrame, n: int | None = None, descending: bool = False,
                  tie: Sequence[str] = ("seq",)) -> DataFrame:
    ordered = df.orderBy(*source_order(descending), *tie)
    return ordered if n is None else ordered.limit(n)


def analysed_only(df: DataFrame, analysis: DataFrame, key: str = "id", min_confidence: float = 0.6) -> DataFrame:
    """Keep posts whose analysis approves; take over its title and statement.

    ``analysis``: key, is_ml_problem, confidence, details struct(title, problem_statement),
    failed. A post whose analysis failed, or that has none, stays as it is.
    """
    a = analysis.select(
        key, "is_ml_problem", "confidence", "details", F.coalesce("failed", F.lit(False)).alias("failed"),
        F.lit(True).alias("_analysed"),
    )
    j = df.join(a, key, "left")
    failed = F.col("_analysed").isNull() | F.col("failed")
    keep = failed | (F.col("is_ml_problem") & (F.col("confidence") >= min_confidence))
    j = j.where(keep)
    return j.withColumns(
        {
            "title": F.when(~failed, F.coalesce(X.filled("details.title"), "title")).otherwise(F.col("title")),
            "description": F.when(
                ~failed, F.coalesce(X.filled("details.problem_statement"), "description")
            ).otherwise(F.col("description")),
        }
    ).drop("is_ml_problem", "confidence", "details", "failed", "_analysed")


# -- keyword predicates of the sources --------------------------------------


def is_ml_competition(description: X.Col) -> Column:
    return X.any_keyword(F.lower(X.blank(description)), V.COMPETITION_ML)


def is_ml_dataset(title: X.Col, description: X.Col, usability: X.Col, downloads: X.Col,
                  min_usability: float = 5.0, min_downloads: int = 50) -> Column:
    text = X.combined(title, description)
    popular = (F.coalesce(X.as_col(usability), F.lit(0.0)) >= min_usability) | (
        F.coalesce(X.as_col(downloads), F.lit(0)) >= min_downloads
    )
    return X.any_keyword(text, V.DATASET_ML) & popular


def is_ml_issue(title: X.Col, body: X.Col, include: Sequence[str] = V.ISSUE_ML,
                reject: Sequence[str] = V.ISSUE_REJECT) -> Column:
    text = X.combined(title, body)
    return X.any_keyword(text, include) & ~X.any_keyword(text, reject)


def mentions_ml(text: X.Col, include: Sequence[str] = V.ISSUE_ML) -> Column:
    return X.any_keyword(F.lower(X.blank(text)), include)


# -- catalogs ---------------------------------------------------------------


def catalog_reject_reasons(min_size: int | None = None, max_size: int | None = None) -> Column:
    """Why an entry is refused; empty when it is kept."""
    title, desc, ident = X.filled("title"), X.filled("description"), X.filled("id")
    size = F.coalesce("size", F.lit(0))
    return F.array_compact(
        F.array(
            F.when(desc.isNull() & title.isNull(), "no description and no title"),
            F.when(
                (size > 0) & ((size < F.lit(min_size or 0)) | (size > F.lit(2**63 - 1 if max_size is None else max_size))),
                F.concat(F.lit("size "), size.cast("string"), F.lit(" out of range")),
            ),
            F.when(title.isNull() & ident.isNull(), "no title or id"),
        )
    )


def catalog_score() -> Column:
    downloads = F.least(F.coalesce("download_count", F.lit(0)) / 1000, F.lit(1.0))
    return F.coalesce("usability_rating", F.lit(0.0)) * 0.7 + downloads * 0.3


def filter_catalog(df: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Drop unusable entries and fill empty descriptions."""
    kept = df.where(F.size(catalog_reject_reasons(min_size, max_size)) == 0)
    default = F.concat(
        F.coalesce("source", F.lit("unknown")), F.lit(" dataset: "),
        F.coalesce("title", "id", F.lit("Unknown")),
    )
    return kept.withColumn("description", F.coalesce(X.filled("description"), default))


def filter_rank_catalog(df: DataFrame, min_size: int | None = None, max_size: int | None = None,
                        tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Usable entries, best score first."""
    scored = filter_catalog(df, min_size, max_size).withColumn("score", catalog_score())
    return scored.orderBy(F.col("score").desc(), *tie)


def rerank_by_source(matches: DataFrame, source: str = "source", similarity: str = "similarity",
                     tie: Sequence[str] = ("seq",)) -> list[Column]:
    """Sort keys: preferred sources first, then similarity, high to low."""
    table = F.create_map(*[F.lit(x) for kv in V.SOURCE_PRIORITY.items() for x in kv])
    prio = F.coalesce(table[F.col(source)], F.lit(V.SOURCE_PRIORITY_OTHER))
    return [prio.asc(), F.col(similarity).desc(), *[F.col(t).asc() for t in tie]]


def first_usable(matches: DataFrame, available: DataFrame, key: str = "problem_id", dataset: str = "dataset_id",
                 order: Sequence[Column | str] | None = None) -> DataFrame:
    """Per problem the first match, in order, whose dataset could be fetched.

    ``available``: dataset, ok. Fetched data carries its provenance.
    """
    ok = available.where("ok").select(dataset).distinct()
    usable = matches.join(ok, dataset, "left_semi")
    order = order or rerank_by_source(matches, tie=(dataset,))
    return first_per_group(usable, [key], order)


GRAM = 3
COUNTERS = 1 << 16  # pieces of three characters are few


def _grams(word: Column, length: int) -> Column:
    n = F.length(word)
    starts = F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(length))))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): the words of ``short`` that lie in words of ``long``; both have one column of distinct words.

    A word is filed under its rarest piece of three characters, or under itself if it is shorter; the
    longer side looks under all its pieces of one to three characters, three times its length at most.
    Words that meet are compared whole.
    """
    s, l = short.toDF("short"), long.toDF("long")
    grams = l.select("long", _grams(F.col("long"), GRAM).alias("toks"))
    table = J.rarity(grams, counters=COUNTERS)
    rarest = F.get(J.keys(_grams(F.col("short"), GRAM), table), F.lit(0))
    filed = s.where("short <> ''").select("short", F.when(F.length("short") >= GRAM, rarest).otherwise(F.xxhash64("short")).alias("piece"))
    small = [F.transform(_grams(F.col("long"), k), lambda x: F.xxhash64(x)) for k in range(1, GRAM)]
    looked = grams.select("long", F.explode(F.array_distinct(F.concat(J.keys("toks", table), *small))).alias("piece"))
    return filed.join(looked, "piece").where(F.col("long").contains(F.col("short"))).select("short", "long").distinct()


def _keyword_hits(asked: DataFrame, catalog: DataFrame, entry_id: str, entry_keywords: str) -> DataFrame:
    """(kw, entry): the entries with a keyword that contains, or lies in, an asked one."""
    listed = catalog.select(entry_id, F.explode(F.array_distinct(entry_keywords)).alias("dk"))
    kws, dks = asked.select("kw").distinct(), listed.select("dk").distinct()
    pairs = contained(kws, dks).toDF("kw", "dk").unionByName(contained(dks, kws).toDF("dk", "kw")).distinct()
    return pairs.join(listed, "dk").select("kw", entry_id).distinct()


def _asking_nothing(queries: DataFrame, catalog: DataFrame, query_id: str, keywords: str, entry_id: str) -> DataFrame:
    blank = queries.where(F.coalesce(F.size(keywords), F.lit(0)) <= 0).select(query_id).distinct()
    entry = F.lit(None).cast(catalog.schema[entry_id].dataType)
    return blank.select(query_id, entry.alias(entry_id), F.lit(0).cast("long").alias("score"))


def keyword_scores(queries: DataFrame, catalog: DataFrame, query_id: str = "query_id", keywords: str = "keywords",
                   entry_id: str = "dataset_id", entry_keywords: str = "keywords") -> DataFrame:
    """Catalog entries by number of query keywords that contain, or lie in, one of theirs.

    A query without keywords asks for nothing in particular: it has one row with score 0 and no entry,
    which stands for every entry. ``top_entries`` resolves it. There is a row for every query and entry that
    share something; for the best entries of many queries take ``search_entries``.
    """
    asked = queries.select(query_id, F.explode(F.transform(keywords, F.lower)).alias("kw"))
    hits = _keyword_hits(asked, catalog, entry_id, entry_keywords)
    counted = asked.groupBy(query_id, "kw").agg(F.count("*").alias("_n"))
    scored = counted.join(hits, "kw").groupBy(query_id, entry_id).agg(F.sum("_n").alias("score"))
    return scored.unionByName(_asking_nothing(queries, catalog, query_id, keywords, entry_id))


def search_entries(queries: DataFrame, catalog: DataFrame, n: int, query_id: str = "query_id", keywords: str = "keywords",
                   entry_id: str = "dataset_id", entry_keywords: str = "keywords") -> DataFrame:
    """``top_entries`` of ``keyword_scores``, without a row for every query and entry.

    Queries with the same keywords are one. Entries that are hit by the same asked keywords score alike in
    every query, so they are one class, of which no query needs more than the first ``n``; and as a class
    holds an entry at least, no query needs more than its ``n`` best classes.
    """
    asked = queries.select(query_id, F.explode(F.transform(keywords, F.lower)).alias("kw")).where("kw IS NOT NULL")
    counted = asked.groupBy(query_id, "kw").agg(F.count("*").alias("_n"))
    asking = cut(counted.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("kw", "_n"))).alias("_bag")))
    bags = asking.select("_bag").distinct()

    hits = _keyword_hits(asked, catalog, entry_id, entry_keywords)
    entries = hits.groupBy(entry_id).agg(F.sort_array(F.collect_set("kw")).alias("_hit"))
    members = cut(first_per_group(entries, ["_hit"], [entry_id], n))
    classes = members.groupBy("_hit").agg(F.min(entry_id).alias("_first"))

    scored = (
        bags.select("_bag", F.inline("_bag")).join(classes.select("_first", F.explode("_hit").alias("kw")), "kw")
        .groupBy("_bag", "_first").agg(F.sum("_n").alias("score"))
    )
    best = first_per_group(scored, ["_bag"], [F.col("score").desc(), F.col("_first")], n)
    named = best.join(classes, "_first").join(members, "_hit").select("_bag", entry_id, "score")
    few = first_per_group(named, ["_bag"], [F.col("score").desc(), F.col(entry_id)], n)
    found = asking.join(few, "_bag").select(query_id, entry_id, "score")
    return top_entries(found.unionByName(_asking_nothing(queries, catalog, query_id, keywords, entry_id)), catalog, n, query_id, entry_id)


def top_entries(scores: DataFrame, catalog: DataFrame, n: int, query_id: str = "query_id", entry_id: str = "dataset_id") -> DataFrame:
    """(query, entry, score, rank): the ``n`` best entries of each query, equal scores by entry.

    A query for every entry gets the first ``n`` of the catalog, which are all that it needs of it.
    """
    first = catalog.select(entry_id).distinct().orderBy(entry_id).limit(n)
    some = scores.where(F.col(entry_id).isNull()).select(query_id, "score", F.lit(0).alias("_k"))
    every = some.join(F.broadcast(first.withColumn("_k", F.lit(0))), "_k").select(query_id, entry_id, "score")  # n rows
    named = first_per_group(scores.where(F.col(entry_id).isNotNull()), [query_id], [F.col("score").desc(), F.col(entry_id)], n)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(entry_id))
    return named.unionByName(every).withColumn("rank", F.row_number().over(order))


def keyword_buckets(queries: DataFrame, buckets: DataFrame, n: int | None = None, query_id: str = "query_id", keywords: str = "keywords",
                    bucket: str = "bucket", key: str = "keyword", place: str = "place") -> DataFrame:
    """(query, bucket, place): the buckets whose keyword lies in a query's joined keywords, the first ``n`` by place.

    A query without keywords gets all buckets. ``buckets`` is a small table of topics.
    """
    text = F.lower(F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))
    asked = queries.select(query_id, text.alias("_text"), (F.coalesce(F.size(keywords), F.lit(0)) <= 0).alias("_all"))
    words = buckets.select(F.lower(key).alias("_word")).distinct()
    hits = contained(words, asked.select("_text").distinct()).toDF("_word", "_text")
    topics = buckets.select(F.lower(key).alias("_word"), bucket, place)
    found = asked.where("NOT _all").join(hits, "_text").join(topics, "_word").select(query_id, bucket, place)
    blank = asked.where("_all").select(query_id).withColumn("_k", F.lit(0)).join(
        F.broadcast(buckets.select(bucket, place).withColumn("_k", F.lit(0))), "_k").select(query_id, bucket, place)
    both = found.unionByName(blank).distinct()
    return both if n is None else first_per_group(both, [query_id], [place], n)


def joined_keyword_text(keywords: X.Col) -> Column:
    return F.lower(F.array_join(X.as_col(keywords), " "))


def any_keyword_of(keywords: X.Col, wanted: Sequence[str]) -> Column:
    """Is any of the keywords one of the wanted words?"""
    return F.arrays_overlap(
        F.transform(X.as_col(keywords), F.lower), F.array(*[F.lit(w) for w in wanted])
    )


def task_category(task: X.Col) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.TASK_CATEGORY.items() for x in kv])
    return table[X.as_col(task)]
