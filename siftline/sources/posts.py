"""Landed records of four kinds to the common post schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import ingest as I
from siftline.schemas import PROBLEM


def _shape(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    cols = {**cols, "seq": F.col("seq"), "mined_at": F.current_timestamp()}
    return df.select(
        *[
            cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PROBLEM.fields
        ]
    )


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _two_paragraphs(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("\n\n"), b)


def competitions(raw: DataFrame, ml_only: bool = True) -> DataFrame:
    """raw: seq, ref, slug, title, description, subtitle, deadline, category, reward."""
    ref = F.coalesce(X.filled("ref"), X.filled(_opt(raw, "slug")))
    desc = F.coalesce(
        X.filled(_opt(raw, "description")), X.filled(_opt(raw, "subtitle")),
        F.concat(F.lit("Kaggle competition: "), ref),
    )
    title = F.coalesce(_opt(raw, "title"), ref)
    df = raw.withColumns({"_ref": ref, "_desc": desc, "_title": title}).where("_ref is not null")
    if ml_only:
        df = df.where(I.is_ml_competition("_desc"))
    r, d, t = F.col("_ref"), F.col("_desc"), F.col("_title")
    return _shape(df, {
        "id": r, "source": F.lit("kaggle"), "source_type": F.lit("competition"), "title": t,
        "description": d, "full_text": _two_paragraphs(t, d), "competition_ref": r,
        "url": F.concat(F.lit("https://www.kaggle.com/competitions/"), r),
        "deadline": _opt(raw, "deadline"), "category": _opt(raw, "category"), "reward": _opt(raw, "reward"),
    })


def dataset_posts(raw: DataFrame, ml_only: bool = True) -> DataFrame:
    """raw: seq, ref 'owner/name', title, description, subtitle, usability, download_count."""
    desc = F.coalesce(X.filled(_opt(raw, "description")), X.filled(_opt(raw, "subtitle")), F.lit(""))
    df = raw.where(X.owner_and_name("ref").isNotNull()).withColumns(
        {"_desc": desc, "_title": F.coalesce(_opt(raw, "title"), F.col("ref"))}
    )
    if ml_only:
        df = df.where(I.is_ml_dataset(X.blank(_opt(raw, "title")), "_desc", "usability", "download_count"))
    r, t, d = F.col("ref"), F.col("_title"), X.filled("_desc")
    return _shape(df, {
        "id": r, "source": F.lit("kaggle"), "source_type": F.lit("dataset"), "title": t,
        "description": F.coalesce(d, F.concat(F.lit("Kaggle dataset: "), r)),
        "full_text": _two_paragraphs(t, F.coalesce(d, F.lit("ML dataset from Kaggle"))),
        "url": F.concat(F.lit("https://www.kaggle.com/datasets/"), r), "dataset_ref": r,
        "usability": F.coalesce("usability", F.lit(0.0)), "download_count": F.coalesce("download_count", F.lit(0)),
    })


def issues(raw: DataFrame, ml_only: bool = True) -> DataFrame:
    """raw: seq, id, number, title, body, html_url, labels[{name}], comments, created_at, repository."""
    df = raw.where(I.is_ml_issue("title", "body")) if ml_only else raw
    body = X.blank("body")
    return _shape(df, {
        "id": F.concat(F.lit("github_issue_"), F.col("id").cast("string")), "source": F.lit("github"),
        "source_type": F.lit("issue"), "title": F.col("title"), "description": body,
        "full_text": _two_paragraphs(F.col("title"), body), "url": F.col("html_url"),
        "issue_number": F.col("number"), "repository": F.col("repository"),
        "labels": F.transform("labels", lambda x: x["name"]), "comments_count": _opt(raw, "comments"),
        "created_at": _opt(raw, "created_at"),
    })


def readmes(raw: DataFrame, ml_only: bool = True, head: int = 500, body: int = 1000) -> DataFrame:
    """raw: seq, id, name, full_name, content, html_url, stars."""
    df = raw.where(I.mentions_ml("content")) if ml_only else raw
    return _shape(df, {
        "id": F.concat(F.lit("github_repo_"), F.col("id").cast("string")), "source": F.lit("github"),
        "source_type": F.lit("readme"), "title": F.concat(F.col("name"), F.lit(": ML Problem from README")),
        "description": F.substring("content", 1, head), "full_text": F.substring("content", 1, body),
        "url": F.col("html_url"), "repository": F.col("full_name"), "stars": F.col("stars"),
    })


def statements(raw: DataFrame, width: int = 100) -> DataFrame:
    """raw: seq, id, statement. A direct statement is its own title, description and text."""
    s = F.col("statement")
    title = F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)
    return _shape(raw, {
        "id": F.col("id").cast("string"), "source": F.lit("direct_input"), "title": title,
        "description": s, "full_text": s,
    })


KINDS = {
    "competition": competitions, "dataset": dataset_posts, "issue": issues, "readme": readmes,
    "statement": statements,
}


def normalise_problems(raw: DataFrame, kind: str, **options) -> DataFrame:
    return KINDS[kind](raw, **options)
