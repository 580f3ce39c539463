"""Landed catalog records of six sources to the common dataset schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.schemas import DATASET

# ---------------------------------------------------------------------------
# Ratings the sources are given, and their page addresses.
# ---------------------------------------------------------------------------
RATING = {"huggingface": 0.0, "uci": 0.8, "datagov": 0.6, "worldbank": 0.7, "aws_opendata": 0.5}
PAGE = {
    "kaggle": "https://www.kaggle.com/datasets/",
    "huggingface": "https://huggingface.co/datasets/",
    "uci": "https://archive.ics.uci.edu/dataset/",
    "datagov": "https://catalog.data.gov/dataset/",
    "worldbank": "https://data.worldbank.org",
    "aws_opendata": "https://registry.opendata.aws/",
}
# --- end of fixed values ---------------------------------------------------


def _shape(df: DataFrame, source: str, cols: dict[str, Column]) -> DataFrame:
    base = {
        "seq": F.col("seq"), "source": F.lit(source), "size": F.lit(0), "download_count": F.lit(0),
        "files": F.array().cast("array<string>"), "usability_rating": F.lit(RATING.get(source, 0.0)),
    }
    cols = {**base, **cols}
    return df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DATASET.fields])


def kaggle(raw: DataFrame) -> DataFrame:
    """raw: seq, ref, title, size, usability, downloads, files, meta struct (may be NULL)."""
    df = raw.where(X.owner_and_name("ref").isNotNull())
    m, has = F.col("meta"), F.col("meta").isNotNull()
    title = F.coalesce("title", "ref")

    def pick(field: str, other: Column) -> Column:
        return F.when(has, F.coalesce(m[field], other)).otherwise(other)

    return _shape(df, "kaggle", {
        "id": F.col("ref"), "title": pick("title", title), "description": F.when(has, X.blank(m["description"])).otherwise(""),
        "size": pick("totalBytes", F.coalesce("size", F.lit(0))), "files": F.col("files"),
        "download_count": pick("downloadCount", F.coalesce("downloads", F.lit(0))),
        "usability_rating": pick("usabilityRating", F.coalesce("usability", F.lit(0.0))),
        "url": F.concat(F.lit(PAGE["kaggle"]), F.col("ref")),
        "tags": F.when(has, m["tags"]).otherwise(F.array().cast("array<string>")),
    })


def huggingface(raw: DataFrame) -> DataFrame:
    """raw: seq, id, description, downloads, tags."""
    return _shape(raw, "huggingface", {
        "id": F.col("id"), "title": F.element_at(F.split("id", "/"), -1), "description": F.col("description"),
        "download_count": F.coalesce("downloads", F.lit(0)), "tags": F.col("tags"),
        "url": F.concat(F.lit(PAGE["huggingface"]), F.col("id")),
    })


def uci(raw: DataFrame) -> DataFrame:
    """raw: seq, uci_id, name, keywords."""
    slug = F.regexp_replace(F.lower("name"), " ", "+")
    ident = F.col("uci_id").cast("string")
    return _shape(raw, "uci", {
        "id": ident, "title": F.col("name"), "tags": F.col("keywords"),
        "description": F.concat(F.lit("UCI ML Repository: "), F.col("name")),
        "url": F.concat(F.lit(PAGE["uci"]), ident, F.lit("/"), slug),
    })


def datagov(raw: DataFrame, max_files: int = 3, width: int = 500) -> DataFrame:
    """raw: seq, id, name, title, notes, resources[{format, url}], tags[{name}]."""
    res = F.col("resources")
    usable = F.filter(res, lambda r: F.upper(X.blank(r["format"])).isin("CSV", "JSON"))
    chosen = F.when(F.size(usable) > 0, usable).otherwise(F.slice(res, 1, 1))
    df = raw.withColumn("_res", chosen)
    urls = F.transform(F.slice("_res", 1, max_files), lambda r: r["url"])
    return _shape(df, "datagov", {
        "id": F.coalesce(X.filled("id"), F.col("name"), F.lit("")),
        "title": F.coalesce("title", "name", F.lit("Unknown")),
        "description": F.substring(X.blank("notes"), 1, width),
        "files": F.filter(urls, lambda u: X.filled(u).isNotNull()),
        "download_url": F.try_element_at("_res", F.lit(1))["url"],
        "url": F.concat(F.lit(PAGE["datagov"]), X.blank("name")),
        "tags": F.transform("tags", lambda t: X.blank(t["name"])),
    })


def worldbank(raw: DataFrame) -> DataFrame:
    """raw: seq, id, title, description, tags."""
    return _shape(raw, "worldbank", {
        **{c: F.col(c) for c in ("id", "title", "description", "tags")}, "url": F.lit(PAGE["worldbank"]),
    })


def aws_opendata(raw: DataFrame) -> DataFrame:
    """raw: seq, keyword, bucket, title."""
    return _shape(raw, "aws_opendata", {
        "id": F.concat(F.lit("s3://"), F.col("bucket")), "title": F.col("title"),
        "description": F.concat(F.lit("AWS Open Data bucket: "), F.col("bucket")),
        "url": F.concat(F.lit(PAGE["aws_opendata"]), F.col("bucket")), "tags": F.array("keyword"),
    })


SOURCES = {f.__name__: f for f in (kaggle, huggingface, uci, datagov, worldbank, aws_opendata)}


def normalise_catalog(raw: DataFrame, source: str) -> DataFrame:
    return SOURCES[source](raw)
