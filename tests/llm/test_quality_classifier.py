import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import quality_classifier as Q
from siftline.llm import queries
from siftline.session import load


def test_held_out_accuracy(spark):
    """Labels of held-out documents against predictions; the labelled tables are those of scale 0.1."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    rows = queries.QUERIES["op13_quality_classifier"](spark, sf).collect()
    assert len(rows) == load(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    tested = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y, _ in tested if y == 0], [s for s, y, _ in tested if y == 1]
    above = np.mean([[g > b for b in bad] for g in good])
    right = {y: np.mean([p == y for _, x, p in tested if x == y]) for y in (0, 1)}
    print("area under the curve", above, "right by label", right, "tested", len(tested))
    assert len(bad) > 50 and above >= 0.97 and right[1] >= 0.98 and right[0] >= 0.85


def test_context_sums_equal_brute_force(spark):
    texts = ["one two two, three!", "", None, "one", "x" * 40 + " two one", "a b c d e f g"] * 3
    places, signs = Q.index_vectors()
    want, count = np.zeros((Q.BUCKETS, Q.DIMS)), np.zeros(Q.BUCKETS)
    for t in texts:
        buckets = [int(b) for some in Q.slices(t) for b in some]
        for i, b in enumerate(buckets):
            count[b] += 1
            for j in range(max(0, i - 2), min(len(buckets), i + 3)):
                if j != i:
                    np.add.at(want[b], places[buckets[j]], signs[buckets[j]])
    mean = want / np.maximum(count, 1)[:, None]
    mean[count > 0] -= want.sum(0) / count.sum()
    want = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
    got = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-5)


def test_tokens_and_slices():
    text = "Ab1c, d\u00e9!! \t***x"
    assert Q._token.findall(text.encode()) == [b"Ab", b"1", b"c", b",", "d\u00e9".encode(), b"!!", b"***", b"x"]
    long = "word " * (Q.LONG_TEXT // 4)
    parts = list(Q.slices(long))
    assert len(parts) > 1 and sum(map(len, parts)) == Q.LONG_TEXT // 4 and max(map(len, parts)) <= Q.SLICE
    vectors = np.random.default_rng(0).normal(size=(Q.BUCKETS, Q.DIMS)).astype(np.float32)
    x = Q.pooled("a b a", vectors)
    tokens = next(Q.slices("a b a"))
    assert np.allclose(x[: Q.DIMS], vectors[tokens].mean(0), atol=1e-5) and len(x) == Q.FEATURES
    assert not Q.pooled(" \n", vectors).any() and not Q.pooled(None, vectors).any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 10))
    p = 1 / (1 + np.exp(-2 * (np.abs(x[:, 0]) * 2 - x[:, 1] - 1.5)))
    y = (rng.random(4000) < p).astype(float)
    back = rng.random(4000) < 0.2
    net = Q.train(x[:3000], y[:3000], back[:3000])
    got = net.score(x[3000:])
    assert np.abs(got - p[3000:]).mean() < 0.08
    z = rng.normal(size=4000) * 2
    hot = Q.calibrate(3 * z, (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float))
    assert 2.5 < hot < 3.6


def test_edge_tables(spark):
    rows = [(1, "good text here", 0), (None, None, 0), (2, "", 0), (3, "x " * 50_000, 0), (3, "x " * 50_000, 0), (4, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 5), (3, 1)], "doc_id long, quality int")
    model = Q.fit(docs, none)
    assert model[1] is None
    assert [r.score for r in Q.score(docs, model).collect()] == [0.5] * len(rows)
    both = spark.createDataFrame([(1, 1), (4, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    got = Q.score(docs, Q.fit(docs, both)).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert Q.score(docs.limit(0), model).collect() == []
    empty = Q.fit(docs.limit(0), both)
    assert empty[1] is None and not empty[0].any()
    assert [r.h for r in docs.select(Q.held_out().alias("h")).collect()][1] is False
