import math

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import hard_negatives as H
from siftline.llm import queries
from siftline.session import load

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor):
    """Straight from the definition, with Python's whole numbers."""
    sound = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i, label, tuple(max(min(math.floor(256 * x), 1 << 26), -(1 << 26)) for x in v)] = None
    out = []
    for a, x, va in sound:
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, y, v in sound if i != a]
        for s, positive, _ in sorted(r for r in scored if r[2] == x)[:5]:
            fit = sorted(r for r in scored if r[2] != x and 30 * -s <= 100 * -r[0] <= 90 * -s)[:10]
            out += [(a, positive, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def table(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def source(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, ids string, low int").select(
        "vec_id", "label", "embedding", "ids", "low"
    )


def test_query_equals_brute_force(spark, sf):
    rows = load(spark, sf, "embeddings").collect()
    relabelled = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    assert table(queries.QUERIES["op11_hard_negatives"](spark, sf)) == brute(relabelled, lambda i: i % 100 == 0)


def groups(rng, n, centres, dims, noise):
    """Vectors of several lengths around few centres, so that coordinate ranges are narrow."""
    c = rng.normal(size=(centres, dims)) * rng.integers(1, 9, (centres, 1)) * 0.2
    which = rng.integers(0, centres, n)
    return [(i, int(w % 4), [float(x) for x in (c[w] + rng.normal(size=dims) * noise).astype(np.float32)]) for i, w in enumerate(which)]


def test_small_buckets_and_chunks_give_the_same(spark):
    rows = groups(np.random.default_rng(3), 700, 24, 12, 0.03)
    df = H.quantised(source(spark, [(i, v, x) for i, x, v in rows]))
    want = brute(rows, lambda i: i % 9 == 0)
    assert len(want) > 100
    for sizes in ({}, {"bucket": 50, "chunk": 7, "seed_rows": 3}):
        assert table(H.mine(df, F.col("id") % 9 == 0, **sizes)) == want


def test_coordinate_sets_hold_all_rows_that_reach_the_bound():
    rng = np.random.default_rng(4)
    v = np.array([x for _, _, x in groups(rng, 600, 60, 16, 0.02)])
    v = np.floor(2560 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int32)
    ids = np.arange(600)
    bucket = H.Bucket(type("Row", (), H.bucket_row(0, ids, ids * 0, v)), 16)
    scores = v[:50].astype(np.int64) @ v.T.astype(np.int64)
    bound = np.sort(scores, 1)[:, -5:-4].copy()
    ends = np.full((50, 1), H.NONE)
    anchors = H.Anchors(ids[:50], ids[:50], ids[:50] * 0, v[:50], ends, -ends, bound)
    whole, sets = H.candidates(anchors, bucket)
    assert len(sets) > 20 and sum(len(rows) for _, rows in sets) < 0.2 * 600 * len(sets)
    for a, rows in sets:
        assert set((scores[a] >= bound[a, 0]).nonzero()[0]) <= set(rows.tolist())
    left = set(range(50)) - set(whole.tolist()) - {a for a, _ in sets}
    assert all(scores[a].max() < bound[a, 0] for a in left)


def test_edge_tables(spark):
    empty = source(spark, [])
    assert H.mine(H.quantised(empty), F.col("id") % 2 == 0).collect() == []
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.25]), (0, 1, [0.5, 0.25]), (2, 1, [0.5, 0.25]), (4, 1, [0.5]), (6, None, [0.5, 0.1]), (8, 2, [0.25, 0.25]), (10, 2, [0.25, 0.25]),
        (12, 2, None), (14, 2, [nan, 1.0]), (16, 2, [inf, 1.0]), (18, 2, [None, 1.0]), (None, 2, [0.3, 0.3]), (20, 3, []), (22, 3, [0.0, 0.0]), (24, 3, [0.0, 0.0]),
        (26, 4, [1e30, 1.0]), (28, 4, [-1e30, 1.0]), (30, 4, [1e30, 0.0]), (32, 5, [2e5, 1.0]), (-34, 1, [0.4, 0.4]), (36, 5, [0.3, 0.2, 0.1]),
    ]
    df = H.quantised(source(spark, [(i, v, x) for i, x, v in rows]))
    got = table(H.mine(df, F.col("id") % 2 == 0))
    assert got == brute(rows, lambda i: i % 2 == 0) and len(got) > 10
    assert H.mine(df, F.col("id") == 99).collect() == []
