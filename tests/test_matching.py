import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import registry as RG
from siftline.operators import setjoin as J
from siftline.operators import similarity as S
from siftline.operators.knn import knn_join
from siftline.streaming import streams


def texts(n, seed, words=12, copies=0.33):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = " ".join(rnd.sample(vocab, 8))
    out = []
    for _ in range(n):
        if rnd.random() < copies:  # a third of all rows are one text or differ from it in a word
            t = base.split()
            if rnd.random() < 0.4:
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            out.append(" ".join(t))
        else:
            # skewed: low-numbered words are far more frequent
            out.append(" ".join({vocab[min(39, int(rnd.expovariate(0.15)))] for _ in range(rnd.randint(1, words))}))
    return out


def jac(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return 0.0 if not a or not b else len(a & b) / len(a | b)


def sim(a, b):
    if not a.split() and not b.split():
        return 1.0
    if not a.split() or not b.split():
        return 0.0
    if a.lower().strip() == b.lower().strip():
        return 1.0
    j = jac(a, b)
    return min(1.0, j + 0.2) if a.lower() in b.lower() or b.lower() in a.lower() else j


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_candidates_miss_nothing(spark, threshold, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 3)  # force salting of hot prefix tokens
    t = sorted(set(texts(120, 1)))
    d = spark.createDataFrame([(str(i), x.split()) for i, x in enumerate(t)], "k string, toks array<string>")
    got = {(r[0], r[1]) for r in J.candidates(d, d, threshold).collect()}
    want = {(str(i), str(j)) for i, a in enumerate(t) for j, b in enumerate(t) if jac(a, b) >= threshold}
    assert want <= got and len(got) < len(t) ** 2


@pytest.mark.parametrize("terms,threshold", [((), 0.4), (("w0", "w1", "w2", "w5"), 0.5), (("w0", "w1", "w2", "w3", "w4", "w5"), 0.4)])
def test_match_equals_brute_force(spark, terms, threshold):
    ps, ds = texts(40, 2) + ["", "unknown words only"], texts(150, 3) + [""]
    p = spark.createDataFrame(list(enumerate(ps)), "problem_id long, match_text string")
    d = spark.createDataFrame(list(enumerate(ds)), "dataset_id long, match_text string")
    got = {(r[0], r[1]): (round(r[2], 9), r[3]) for r in S.match(p, d, threshold=threshold, terms=terms).collect()}
    want = {}
    for i, a in enumerate(ps):
        scored = []
        for j, b in enumerate(ds):
            s = jac(a, b)
            for t in terms:
                s += 0.1 if t in a and t in b else 0.0
            scored.append((-min(1.0, s), j))
        scored.sort()
        keep = [x for x in scored if -x[0] >= threshold][:3] or scored[:1]
        want.update({(i, j): (round(-s, 9), r + 1) for r, (s, j) in enumerate(keep)})
    assert got == want


def test_best_match_equals_brute_force(spark):
    qs, rs = texts(60, 4) + ["", "w1"], texts(80, 5) + ["  ", "w1 w2 w3 w4 w5"]
    q = spark.createDataFrame(list(enumerate(qs)), "id long, signature string")
    r = spark.createDataFrame(list(enumerate(rs)), "registry_seq long, signature string")
    got = {x[0]: (x[1], round(x[2], 9)) for x in S.best_match(q, r, 0.6).collect()}
    want = {}
    for i, a in enumerate(qs):
        s, j = max((sim(a, b), -j) for j, b in enumerate(rs))
        if s >= 0.6:
            want[i] = (-j, round(s, 9))
    assert got == want


@pytest.mark.parametrize("pivots,block", [(1, 4096), (8, 7)])
def test_knn_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5)) + np.repeat(np.eye(5)[:3] * 6, 30, axis=0)
    x[60:] = x[60]  # a third of the rows are copies
    part = [str(i % 2) for i in range(90)]
    d = spark.createDataFrame([(i, part[i], x[i].tolist()) for i in range(90)], "id long, p string, vec array<double>")
    got = {}
    for r in knn_join(d, d, 4, part="p", exclude_self=True, pivots=pivots, block=block).collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"]))
    for i in range(90):
        want = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), j) for j in range(90) if j != i and part[j] == part[i])[:4]
        assert sorted(got[i]) == want, i


def test_cosine_edges(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [-1.0, 0.0])], "id long, vec array<double>")
    c = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "id long, vec array<double>")
    got = {r["id"]: (r["neighbour"], round(r["similarity"], 6)) for r in knn_join(d, c, 1, "cosine", keep_undirected=True).collect()}
    assert got == {0: (0, 1.0), 1: (0, 0.0), 2: (0, 0.0), 3: (0, -1.0)}
    reg = c.withColumnsRenamed({"id": "registry_seq", "vec": "embedding"})
    m = S.best_match_vector(d.withColumnRenamed("vec", "embedding"), reg, 0.5).collect()
    assert [(r[0], r[1]) for r in m] == [(0, 0)]
    e = d.select("id", S.cosine("vec", F.array(F.lit(1.0), F.lit(0.0))).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in e] == [1.0, 0.0, 0.0, -1.0]


def sequential(rows, threshold=0.7):
    """Posts one by one, as in a loop: (leader position, times seen)."""
    kept = []
    for i, t in enumerate(rows):
        best, at = 0.0, None
        for e in kept:
            s = sim(t, rows[e[0]])
            if s > best:
                best, at = s, e
        if at is not None and best >= threshold:
            at[1] += 1
        else:
            kept.append([i, 1])
    return {e[0]: e[1] for e in kept}


def test_grouping_equals_the_sequential_rule(spark):
    rows = texts(150, 6, words=7)
    d = spark.createDataFrame(list(enumerate(rows)), "seq long, signature string")
    got = {r["leader"]: r["n"] for r in RG.group_batch(d, 0.7).groupBy("leader").agg(F.count("*").alias("n")).collect()}
    assert got == sequential(rows)


def test_stream_registry_equals_sequential_and_replays(spark, tmp_path):
    rows = texts(120, 7, words=7)
    half = spark.createDataFrame(
        [(i % 60, i // 60, "", t, "s", "u", "classification" if i % 2 else "regression", f"d{i % 3}") for i, t in enumerate(rows)],
        "seq long, part int, title string, description string, source string, url string, task_type string, dataset_id string")
    src = str(tmp_path / "in")
    for b in (0, 1):
        half.where(F.col("part") == b).drop("part").coalesce(1).write.mode("append").parquet(src)
    stream = streams.post_stream(spark, src, half.drop("part").schema)
    reg = streams.run_registry_stream(stream, str(tmp_path / "reg"), str(tmp_path / "cp"), 0.7)
    want = sequential([t for t in rows])
    got = {(r["registry_seq"] // RG.BATCH_STRIDE) * 60 + r["registry_seq"] % RG.BATCH_STRIDE: r["seen_count"] for r in reg.current().collect()}
    assert got == want
    reg.register(half.where("part = 1").drop("part"), 1)  # the same batch once more
    assert {r["registry_seq"]: r["seen_count"] for r in reg.current().collect()} == {
        (k // 60) * RG.BATCH_STRIDE + k % 60: v for k, v in want.items()}


def test_model_registry(spark):
    runs = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a", "a", "b"])], "seq long, signature string").selectExpr(
        "seq", "signature", "struct('t' as title, 'd' as description) as problem", "struct('i' as id, 't' as title, 'd' as description) as dataset",
        "'classification' as task_type", "concat('m', seq) as model_path",
        "named_struct('task_type','c','best_model','RF','accuracy',0.9D,'precision',0.9D,'recall',0.9D,'f1_score',0.9D,'r2',cast(null as double),'mse',cast(null as double)) as metrics",
        "timestamp_seconds(seq) as trained_at")
    reg = RG.register_models(RG.empty_registry(spark, "model"), runs, limit=2)
    got = {r["signature"]: (r["train_count"], r["model_paths"]) for r in reg.collect()}
    assert got == {"a": (2, ["m0", "m1"]), "b": (1, ["m3"])}
    assert [r["seq"] for r in RG.refused_models(RG.empty_registry(spark, "model"), runs, limit=2).collect()] == [2]
    again = RG.register_models(reg, runs, limit=2)
    assert {r["signature"]: r["train_count"] for r in again.collect()} == {"a": 2, "b": 2}


def admitted(entries, runs, threshold, limit):
    """Runs registered one by one: entries are [signature, times]."""
    entries, out = [list(e) for e in entries], {}
    for seq, s in runs:
        best = max(((jac(s, e[0]), -i) for i, e in enumerate(entries)), default=(0, 0))
        if best[0] >= threshold and entries[-best[1]][1] >= limit:
            out[seq] = False
            continue
        own = next((e for e in entries if e[0] == s), None)
        if own is None:
            entries.append([s, 1])
        else:
            own[1] += 1
        out[seq] = True
    return out, {e[0]: e[1] for e in entries}


@pytest.mark.parametrize("threshold,limit", [(0.5, 2), (0.85, 1), (0.3, 3)])
def test_runs_are_admitted_in_order(spark, threshold, limit):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(7)]
    make = lambda: " ".join(rnd.sample(vocab, rnd.randint(2, 5)))
    pool = [make() for _ in range(25)]
    runs = [(i, rnd.choice(pool)) for i in range(100)] + [(100 + i, pool[0]) for i in range(40)]
    entries = [[s, rnd.randint(1, limit)] for s in dict.fromkeys([make() for _ in range(4)] + pool[:2])]
    reg = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(entries)], "registry_seq long, signature string, train_count int")
    got = {r["seq"]: r["admitted"] for r in RG.admit_runs(reg, spark.createDataFrame(runs, "seq long, signature string"), threshold, limit).collect()}
    assert got == admitted(entries, runs, threshold, limit)[0]
