"""Approximate neighbours: exact with all cells probed, recall with a few, and what a query touches."""

import numpy as np
import pytest

from siftline.operators import ann
from siftline.operators.knn import knn_join
from siftline.session import load


def clustered(spark, n, seed, centres=60, dims=16, copies=True):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(0).normal(size=(centres, dims)) * 3
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))
    if copies:
        x[: n // 3] = x[0]  # a third of the rows are one vector
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def pairs(df):
    return {(r["id"], r["neighbour"], round(r["distance"], 9)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_all_probes_are_exact(spark, metric):
    b, q = clustered(spark, 300, 1), clustered(spark, 80, 2)
    got = ann.approx_join(q, b, 3, metric, probes=30, cell_rows=12, block=20)
    assert pairs(got) == pairs(knn_join(q, b, 3, metric))
    own = ann.approx_join(b, b, 2, metric, probes=30, cell_rows=12, exclude_self=True)
    assert pairs(own) == pairs(knn_join(b, b, 2, metric, exclude_self=True))


def test_recall_of_a_few_probes(spark):
    """Clustered rows: 4 of about 60 cells; the embeddings, which have no clusters: 13 of 16."""
    b, q = clustered(spark, 4000, 3, copies=False), clustered(spark, 300, 4, copies=False)
    exact = knn_join(q, b, 5)
    got = ann.recall(ann.approx_join(q, b, 5, probes=4, cell_rows=64), exact).first()
    assert got["n"] == 1500 and got["recall"] >= 0.9, got
    v = load(spark, "/root/testdata/sf0.1", "embeddings").selectExpr("vec_id AS id", "embedding AS vec")
    some = v.where("id % 10 = 0")
    exact = knn_join(some, v, 3, "cosine", exclude_self=True)
    got = ann.recall(ann.approx_join(some, v, 3, "cosine", probes=13, cell_rows=125, exclude_self=True), exact).first()
    assert got["recall"] >= 0.9, got


def test_recall_without_a_number_of_probes(spark):
    """Vectors without clusters need most cells, clustered ones a few."""
    v = load(spark, "/root/testdata/sf0.1", "embeddings").selectExpr("vec_id AS id", "embedding AS vec")
    exact = knn_join(v.where("id % 10 = 0"), v, 3, "cosine", exclude_self=True)
    got = ann.recall(ann.approx_join(v.where("id % 10 = 0"), v, 3, "cosine", cell_rows=50, exclude_self=True), exact).first()
    assert got["n"] == 600 and got["recall"] >= 0.9, got
    used = []
    needed = ann.probes_needed
    ann.probes_needed = lambda *a: used.append(needed(*a)) or used[-1]
    try:
        b = clustered(spark, 4000, 3, copies=False)
        got = ann.recall(ann.approx_join(b.where("id < 300"), b, 5, cell_rows=64), knn_join(b.where("id < 300"), b, 5)).first()
    finally:
        ann.probes_needed = needed
    assert got["recall"] >= 0.9 and used[0] <= 15, (got, used)


def test_two_level_cells():
    rng = np.random.default_rng(5)
    pivots = rng.normal(size=(400, 8))
    cells = ann.Cells(pivots)
    assert sorted(np.concatenate(cells.members).tolist()) == list(range(400)) and len(cells.coarse) == 20
    x = rng.normal(size=(200, 8))
    all_groups = cells.nearest(x, 3, 20)[0]
    want = np.argsort(((x[:, None] - pivots[None]) ** 2).sum(2), 1, kind="stable")[:, :3]
    assert (all_groups == want).all()
    assert (cells.nearest(x, 1, 4)[0][:, 0] == want[:, 0]).mean() > 0.8


def test_edges(spark):
    schema = "id long, vec array<double>"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], schema)
    assert ann.approx_join(one, none, 2).collect() == [] and ann.approx_join(none, one, 2).collect() == []
    assert [(r["id"], r["neighbour"]) for r in ann.approx_join(one, one, 1, "cosine").collect()] == [(1, 1)]


def test_queries_are_not_copied_for_their_cells(spark, monkeypatch):
    """300 queries in 20 cells each were 6,000 rows of a shuffle; strings as ids keep their order on a tie."""
    b, q = (clustered(spark, n, seed).selectExpr("concat('r', id) AS id", "vec") for n, seed in ((600, 8), (300, 9)))
    most, plain = [], ann.cut
    monkeypatch.setattr(ann, "cut", lambda df: most.append(df.count()) or plain(df))
    monkeypatch.setattr(ann, "HELD", 50)
    got = ann.approx_join(q, b, 3, probes=20, cell_rows=15, block=32)
    assert pairs(got) == pairs(knn_join(q, b, 3)) and max(most) <= 600
