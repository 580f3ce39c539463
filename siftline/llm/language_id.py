"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts the n-grams of at most ``per_lang`` texts of each language, those with the smallest
hash of their id (``PER_LANG`` is the documented bound of this sample). Counts are summed by Spark;
only the smoothed log-probability matrix, languages x buckets, reaches the driver and is broadcast.
Scoring turns a batch of texts into one sparse document x bucket matrix (indices and row starts) and
adds up the matrix rows in numpy; whole texts are read, long ones piece by piece.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is everything when no
labelled text was given. Null labels and null texts are not learned from. Ties between languages go
to the first in alphabetical order. Repeated rows count as often as they occur. Other columns pass
through untouched, unless they have the names of the added ones, which then replace them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import free_names, travels

travels(__name__)

UNKNOWN = "und"
PER_LANG = 1000
MAX_LANGS = 256
ORDERS = (1, 2, 3)
BUCKET_BITS = 16
ALPHA = 0.5
PIECE = 200_000
GRAMS_AT_ONCE = 1_000_000


@dataclass
class LanguageModel:
    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x langs


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text, piece by piece."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in ORDERS:
        for at in range(0, max(len(points) - n + 1, 0), PIECE):
            part = points[at : at + PIECE + n - 1]
            code = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                code = (code ^ part[i : len(part) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(32)
            yield (code >> np.uint64(8)).astype(np.int64) & ((1 << BUCKET_BITS) - 1)


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in batch[["lang", "text"]].itertuples(index=False):
            held = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for g in grams(text):
                held += np.bincount(g, minlength=1 << BUCKET_BITS)
    for lang, held in counts.items():
        (used,) = held.nonzero()
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": held[used]})


def fit(labelled: DataFrame, per_lang: int = PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from the rows of ``labelled`` that have a text and a language."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    # A cut of the hash leaves about twice ``per_lang`` ids a language to be ranked, whatever its size.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, (2 * per_lang + 100) / r["count"]))] or [F.lit(""), F.lit(0.0)])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.select("lang", "id").where(place < share[F.col("lang")]).distinct()
    by_hash = Window.partitionBy("lang").orderBy(place, "id")
    # At most MAX_LANGS * per_lang ids: small enough to broadcast.
    sample = few.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_lang)
    chosen = rows.join(F.broadcast(sample.select("id", "lang")), ["id", "lang"])
    counted = chosen.select("lang", "text").mapInPandas(_counter, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = [r.lang for r in sizes]
    table = np.zeros((1 << BUCKET_BITS, len(langs)))
    table[sums["bucket"].to_numpy(np.int64), sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = sums["n"]
    prior = np.array([r["count"] for r in sizes], float)
    smooth = table + ALPHA
    return LanguageModel(langs, np.log(prior / max(prior.sum(), 1)), np.log(smooth / smooth.sum(0)).astype(np.float32))


def posterior(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language of each text and its posterior probability."""
    total = np.tile(model.log_prior, (len(texts), 1))
    parts: list[np.ndarray] = []
    owner: list[int] = []

    def add() -> None:
        if parts:
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            sums = np.add.reduceat(model.log_prob[np.concatenate(parts)], starts, axis=0, dtype=np.float64)
            np.add.at(total, owner, sums)
            parts.clear()
            owner.clear()

    held, most = 0, max(PIECE, GRAMS_AT_ONCE * 4 // max(len(model.langs), 4))
    for i, t in enumerate(texts):
        for g in grams(t):
            parts.append(g)
            owner.append(i)
            held += len(g)
            if held >= most:
                add()
                held = 0
    add()
    best = total.argmax(1)
    odds = np.exp(total - total.max(1, keepdims=True))
    return best, 1 / odds.sum(1)


def predict(
    docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """Add the predicted language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0}, index=texts.index)
        known = texts.notna().to_numpy()
        if known.any() and fitted.langs:
            best, p = posterior(fitted, texts[known].tolist())
            out.loc[known, "lang"] = np.array(fitted.langs, object)[best]
            out.loc[known, "score"] = p
        return out

    letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    return docs.withColumns({lang_pred: predicted(letters)}).withColumns(
        {score: F.col(lang_pred)["score"], lang_pred: F.col(lang_pred)["lang"]}
    )


def held_out(doc_id: str = "doc_id"):
    """True for the documents kept out of fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """Documents whose language is known with a probability of ``least`` or more; same columns."""
    columns = [f"`{c}`" for c in docs.columns]
    lang, score = free_names(docs, "_lang_pred", "_lang_score")
    out = predict(docs, model, text, lang, score)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(columns)
