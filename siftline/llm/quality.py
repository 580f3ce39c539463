"""Quality rules: gradient-boosted trees over document statistics.

Statistics are taken from whole texts. Trees are fitted by histogram boosting with logistic loss on
at most ``MOST_LABELS`` labelled documents, those with the smallest hash of their id (the documented
bound). Features named in ``FALLING`` may only lower the score as they grow: a split that would
raise it is not taken, and the middle of the two leaf values bounds everything below either side.
The fitted trees are flattened into complete numpy node arrays and scored level by level for a
whole batch at once.

A document fails the base rules if it has fewer than 50 words or more than half of them repeat;
otherwise the trees decide.

Edge cases: a null or blank text has no words, all statistics 0, and fails; null labels are not
learned from; with labels of one class only, or none, everything that passes the base rules is
kept; repeated rows are judged alike; other columns pass through ``keep`` and are not read by ``judge``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import shingle_hashes, travels, word_hashes

travels(__name__)

MOST_LABELS = 20_000
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct_words", "log_lines", "line_words",
    "letters", "digits", "upper", "punctuation", "longest_word", "stops",
)
FALLING = ("symbols", "dup_lines", "repeat_words")

_symbol = re.compile(r"[#*$%&|<>]")
_blank = re.compile(r"[\x20\x09-\x0d]")
_letter = re.compile(r"[^\W\d_]")
_digit = re.compile(r"[0-9]")
_upper = re.compile(r"[A-Z]")
_mark = re.compile(r"[.,;:!?]")


# ---- statistics --------------------------------------------------------------------------------


def repeated_words(words: np.ndarray, k: int = 3) -> int:
    """Words in windows of ``k`` words that the text holds twice or more."""
    if len(words) <= k:
        return 0
    windows = shingle_hashes(words, k)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    (at,) = (times[which] > 1).nonzero()
    hit = np.zeros(len(words), bool)
    for i in range(k):
        hit[at + i] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n == 0:
        return [0, 0, len(_symbol.findall(text)), 0, 0], [0.0] * len(FEATURES)
    chars = len(text) - len(_blank.findall(text))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    symbols, repeated = len(_symbol.findall(text)), repeated_words(word_hashes(words))
    stats = [n, chars, symbols, dup, repeated]
    return stats, [
        np.log1p(n), chars / n, symbols / chars, dup / max(len(lines), 1), repeated / n, len(set(words)) / n,
        np.log1p(len(lines)), n / max(len(lines), 1), len(_letter.findall(text)) / chars, len(_digit.findall(text)) / chars,
        len(_upper.findall(text)) / chars, len(_mark.findall(text)) / chars, max(map(len, words)),
        sum(len(w) <= 3 for w in words) / n,
    ]


# ---- boosting ----------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i + 1 (at most the threshold) and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        total = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total


def boost(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    least_rows: int = 20, ridge: float = 1.0,
) -> Trees:
    """Boosted trees with logistic loss; feature j is monotone in direction ``signs[j]`` (0: free)."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    margin = np.full(n, start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(n, np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for q in range(inner):
            (own,) = (node == q).nonzero()
            split = _best_split(binned[own], grad[own], hess[own], edges, signs, low[q], high[q], least_rows, ridge)
            left, right = 2 * q + 1, 2 * q + 2
            low[left] = low[right] = low[q]
            high[left] = high[right] = high[q]
            if split is None:
                node[own] = left
                continue
            j, cut, a, b = split
            feature[q], threshold[q] = j, edges[j][cut]
            node[own] = np.where(binned[own, j] > cut, right, left)
            if signs[j] > 0:
                high[left] = low[right] = (a + b) / 2
            elif signs[j] < 0:
                low[left] = high[right] = (a + b) / 2
        for leaf in range(leaves):
            own = node == inner + leaf
            best = grad[own].sum() / (hess[own].sum() + ridge)
            value[leaf] = rate * np.clip(best, low[inner + leaf], high[inner + leaf])
        # A node without a split sends all rows left; the leaves on its right are copies of no rows.
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
        margin += value[node - inner]
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def _best_split(binned, grad, hess, edges, signs, low, high, least_rows, ridge):
    """The feature, bin and child values of the best allowed split, or None."""
    if len(grad) < 2 * least_rows:
        return None
    g, h, best = grad.sum(), hess.sum(), (1e-9, None)
    whole = g * g / (h + ridge)
    for j, edge in enumerate(edges):
        if not len(edge):
            continue
        size = len(edge) + 1
        gl, hl, nl = (np.bincount(binned[:, j], w, size)[:-1].cumsum() for w in (grad, hess, None))
        a, b = (np.clip(x / (y + ridge), low, high) for x, y in ((gl, hl), (g - gl, h - hl)))
        gain = 2 * a * gl - a * a * (hl + ridge) + 2 * b * (g - gl) - b * b * (h - hl + ridge) - whole
        gain[(nl < least_rows) | (len(grad) - nl < least_rows) | (signs[j] * (b - a) < 0)] = -np.inf
        cut = int(gain.argmax())
        if gain[cut] > best[0]:
            best = (gain[cut], (j, cut, a[cut], b[cut]))
    return best[1]


# ---- Spark jobs --------------------------------------------------------------------------------


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"y": batch["y"], "x": [statistics(t)[1] for t in batch["text"]]})


def fit(
    docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Trees | None:
    """Fit on documents with a 0/1 ``label``; None where there are not two classes to learn."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    # At most ``most`` ids are broadcast and as many feature rows come back.
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    data = rows.select("y", "text").mapInPandas(_featured, "y int, x array<double>").limit(2 * most).toPandas()
    if data["y"].nunique() < 2:
        return None
    data = data.sort_values(["y", "x"], key=lambda s: s.map(tuple) if s.name == "x" else s)
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    return boost(np.array(data["x"].tolist()), data["y"].to_numpy(float), signs)


def judge(
    docs: DataFrame, trees: Trees | None, least: float = 0.5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, quality (the trees' probability) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.pandas_udf(", ".join(f"{c} long" for c in names) + ", base_failed boolean, quality double, kept boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        both = [statistics(t) for t in texts]
        out = pd.DataFrame([s for s, _ in both], columns=names)
        features = np.array([f for _, f in both]).reshape(len(both), len(FEATURES))
        p = 1 / (1 + np.exp(-shared.value.margin(features))) if shared.value is not None else np.ones(len(both))
        out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
        out["quality"] = p
        out["kept"] = ~out["base_failed"] & (p >= least)
        return out

    return docs.select(F.col(doc_id).alias("doc_id"), judged(text).alias("s")).select("doc_id", "s.*")
