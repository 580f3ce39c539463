"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Tokens are runs of letters, of digits and of other marks; they are hashed into ``BUCKETS`` buckets. A
bucket has a sparse random index vector (two entries of +-1). Over all texts, every token adds the index
vectors of the tokens within two places to the context vector of its bucket; these sums are taken per
task and then by Spark. A word vector is the mean context of its bucket less the mean context of all
tokens, at unit length.

A document is pooled to the mean of its tokens' vectors, the spread of the means of its stretches of
``STRETCH`` tokens, and four figures of length and evenness. A network of one hidden layer and an output
is fitted with numpy on at most ``MOST_LABELS`` labelled documents, those with the smallest hash of
their id (the documented bound); a fifth of these is kept back, to stop early and to set the temperature
by which its log-odds are divided. Only text is read for a score.

Texts are read whole, in slices of ``SLICE`` tokens if they are long; contexts end at a slice.

Edge cases: null and blank texts have no tokens and the same score; null labels, labels other than 0
and 1, and labels of null ids are not learned from; without labels of both classes every score is 0.5;
repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import travels, word_hashes

travels(__name__)

BUCKETS = 1 << 15
DIMS = 64
ENTRIES = 2
REACH = 2
STRETCH = 64
SLICE = 1 << 16
TOKENS_AT_ONCE = 1 << 20
LONG_TEXT = 1 << 20
MOST_LABELS = 10_000
HIDDEN = 32
FEATURES = 2 * DIMS + 4

_token = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def slices(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's tokens, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= LONG_TEXT:
        words = _token.findall(raw)
        if words:
            yield _buckets(words)
        return
    found = (m[0] for m in _token.finditer(raw))
    while words := list(islice(found, SLICE)):
        yield _buckets(words)


def _buckets(words: list[bytes]) -> np.ndarray:
    return (word_hashes(words) % np.uint64(BUCKETS)).astype(np.int32)


def index_vectors(seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector; the last one is that of no token."""
    rng = np.random.default_rng(seed)
    places, signs = rng.integers(0, DIMS, (BUCKETS + 1, ENTRIES)).astype(np.int32), rng.choice([-1.0, 1.0], (BUCKETS + 1, ENTRIES))
    signs[BUCKETS] = 0
    return places, signs


def contexts(tokens: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of index vectors around the tokens of each bucket; ``BUCKETS`` stands between texts."""
    out = np.zeros((BUCKETS + 1) * DIMS)
    base = tokens.astype(np.int64) * DIMS
    for off in range(1, REACH + 1):
        for own, other in ((base[:-off], tokens[off:]), (base[off:], tokens[:-off])):
            for e in range(ENTRIES):
                out += np.bincount(own + places[other, e], signs[other, e], len(out))
    return out.reshape(BUCKETS + 1, DIMS)


def _context_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per bucket that occurs in this task: its count and context sums."""
    places, signs = index_vectors()
    gap = np.full(REACH, BUCKETS, np.int32)
    total, count = np.zeros((BUCKETS + 1, DIMS)), np.zeros(BUCKETS + 1, np.int64)
    held, n = [], 0

    def take():
        tokens = np.concatenate(held)
        count.__iadd__(np.bincount(tokens, minlength=BUCKETS + 1))
        total.__iadd__(contexts(tokens, places, signs))

    for b in batches:
        for text in b["text"]:
            for some in slices(text):
                held += [some, gap]
                n += len(some)
                if n >= TOKENS_AT_ONCE:
                    take()
                    held, n = [], 0
    if held:
        take()
    (own,) = (count[:BUCKETS] > 0).nonzero()
    if len(own):
        out = pd.DataFrame(total[own].astype(np.int64), columns=[f"v{i}" for i in range(DIMS)])
        out.insert(0, "n", count[own])
        out.insert(0, "bucket", own.astype(np.int32))
        yield out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The unit vectors of all buckets, from every text of ``docs``."""
    columns = [f"v{i}" for i in range(DIMS)]
    sums = docs.select(F.col(text).alias("text")).mapInPandas(_context_sums, "bucket int, n long, " + ", ".join(f"{c} long" for c in columns))
    sums = sums.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    # A row per bucket at most comes to the driver.
    got = sums.select("bucket", "n", *[(F.col(c) / F.col("n")).cast("float").alias(c) for c in columns]).toPandas()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    if len(got):
        mean = got[columns].to_numpy(np.float64)
        n = got["n"].to_numpy(np.float64)
        mean -= (mean * n[:, None]).sum(0) / n.sum()
        out[got["bucket"].to_numpy()] = mean / np.maximum(np.sqrt((mean * mean).sum(1)), 1e-9)[:, None]
    return out


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """The features of a text."""
    sums, squares, n, stretches, even, most = np.zeros(DIMS), np.zeros(DIMS), 0, 0, 0.0, 0.0
    for tokens in slices(text):
        at = np.arange(0, len(tokens), STRETCH)
        size = np.diff(np.append(at, len(tokens)))
        added = np.add.reduceat(vectors[tokens], at, 0).astype(np.float64)
        means = added / size[:, None]
        length = (means * means).sum(1)
        sums += added.sum(0)
        squares += (means * means).sum(0)
        n, stretches, even, most = n + len(tokens), stretches + len(at), even + length.sum(), max(most, float(length.max()))
    if n == 0:
        return np.zeros(FEATURES, np.float32)
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / stretches - mean * mean, 0))
    return np.concatenate([mean, spread, [np.log1p(n), (mean * mean).sum(), even / stretches, most]]).astype(np.float32)


# ---- the network -------------------------------------------------------------------------------


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and biases of both layers
    temperature: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return _forward((x - self.shift) / self.scale, self.layers)[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, hidden @ layers[2] + layers[3][0]


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def train(x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, size: int = 128, seed: int = 13) -> Network:
    """A network fitted by Adam; ``kept_back`` rows choose the epoch and the temperature."""
    rng = np.random.default_rng(seed)
    if kept_back.all() or not kept_back.any():
        kept_back = np.zeros(len(y), bool)
    own, held = ~kept_back, kept_back if kept_back.any() else ~kept_back
    shift, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = np.clip((x - shift) / scale, -8, 8)
    m = x.shape[1]
    layers = [rng.normal(size=(m, HIDDEN)) * np.sqrt(2 / m), np.zeros(HIDDEN), rng.normal(size=HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
    first, second = ([np.zeros_like(w) for w in layers] for _ in range(2))
    best, step = (np.inf, layers), 0
    xs, ys = z[own], y[own]
    for _ in range(epochs):
        order = rng.permutation(len(ys))
        for s in range(0, len(order), size):
            rows = order[s : s + size]
            hidden, out = _forward(xs[rows], layers)
            error = (_sigmoid(out) - ys[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (hidden > 0)
            grads = [xs[rows].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        loss = _loss(_forward(z[held], layers)[1], y[held])
        if loss < best[0]:
            best = (loss, [w.copy() for w in layers])
    net = Network(shift, scale, best[1], 1.0)
    net.temperature = calibrate(net.log_odds(x[held]), y[held])
    return net


def calibrate(z: np.ndarray, y: np.ndarray, low: float = 0.25, high: float = 8.0) -> float:
    """The temperature of least loss on ``z`` and ``y``, by golden section over its logarithm."""
    a, b, ratio = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if _loss(z / np.exp(c), y) <= _loss(z / np.exp(d), y):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


# ---- Spark jobs --------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents whose labels are not learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pooled_rows(vectors):
    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "back": b["back"], "x": [pooled(t, vectors.value).tolist() for t in b["text"]]})

    return pool


def fit(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all ``docs`` and a network from ``labels``; no network without two classes."""
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    # At most ``most`` labels are broadcast; of documents that share an id, the first text counts.
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("back", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(5)) == 0)
    data = rows.mapInPandas(_pooled_rows(shared), "id long, y int, back boolean, x array<float>").toPandas().sort_values("id")
    if data["y"].nunique() < 2:
        return vectors, None
    return vectors, train(np.array(data["x"].tolist(), np.float64), data["y"].to_numpy(float), data["back"].to_numpy(bool))


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], least: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (the probability of label 1) and predicted (1 from ``least`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        vectors, net = shared.value
        if net is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(net.score(np.array([pooled(t, vectors) for t in texts], np.float64)))

    out = docs.select(F.col(doc_id).alias("doc_id"), scored(text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
