import numpy as np
from pyspark.sql import functions as F

from siftline.operators import evaluate as E
from siftline.operators import features as FX
from siftline.operators import models as MD
from siftline.operators import ranking as R
from siftline.sources import tables


def test_exact_quantiles_both_ways(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=400), np.full(300, 0.25), [np.nan] * 5])
    d = spark.createDataFrame([(float(v), float(i % 7), None) for i, v in enumerate(x)], "a double, b double, c double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    direct = FX.exact_quantiles(d, ["a", "b", "c"], probs)
    large = FX.exact_quantiles(d, ["a", "b", "c"], probs, direct_rows=0, accuracy=50)
    for got in (direct, large):
        assert np.allclose(got["a"], np.nanquantile(x, probs)) and np.allclose(got["b"], np.quantile([i % 7 for i in range(len(x))], probs))
        assert got["c"] == [None] * len(probs)


def test_mark_per_group_is_exact(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 50, None).otherwise("b").alias("g"))
    for digits in (1, 4):
        m = R.mark_per_group(d, "g", "id", F.ceil(F.col("n") * 0.2), digits=digits)
        got = {r["g"]: (r["n"], r["m"]) for r in m.groupBy("g").agg(F.count("*").alias("n"), F.count_if("marked").alias("m")).collect()}
        assert all(m_ == -(-n // 5) for n, m_ in got.values()) and sum(n for n, _ in got.values()) == 1000
    a = R.mark_per_group(d, "g", "id", F.lit(10), digits=1).where("marked").select("id").collect()
    b = R.mark_per_group(d, "g", "id", F.lit(10), digits=4).where("marked").select("id").collect()
    assert sorted(a) == sorted(b) and len(a) == 30


def test_sample_exact(spark):
    d = spark.range(5000)
    got = R.sample_exact(d, "id", 100)
    want = d.orderBy(R.hash_order("id", 42), "id").limit(100)
    assert sorted(got.collect()) == sorted(want.collect())
    assert R.sample_exact(d, "id", 9999).count() == 5000


def test_smote_balances_within_the_class(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i < 40 else (1 if i < 52 else 2), rng.normal(size=3).tolist()) for i in range(59)]
    d = spark.createDataFrame(rows, "id long, y int, vec array<double>")
    got = FX.smote(d, "id", "y")
    counts = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts == {0: 40, 1: 40, 2: 40}
    for y in (1, 2):
        real = np.array([r[2] for r in rows if r[1] == y])
        made = np.array([r["vec"] for r in got.where((F.col("y") == y) & F.col("synthetic")).collect()])
        assert (made >= real.min(0) - 1e-9).all() and (made <= real.max(0) + 1e-9).all()
        # each new row lies on a segment between two rows of its class
        for m in made:
            ok = any(abs(np.linalg.norm(m - a) + np.linalg.norm(m - b) - np.linalg.norm(a - b)) < 1e-6 for a in real for b in real)
            assert ok


def test_encoders_and_scale(spark):
    d = spark.createDataFrame([(1, "b", 1.0), (2, None, 1.0), (3, "a", 9.0), (4, "c", 1.0), (5, "c", 1.0)], "id int, c string, z double")
    assert [r["c"] for r in FX.ordinal_encode(d, ["c"]).orderBy("id").collect()] == [1, 3, 0, 2, 2]
    hot = FX.onehot(d, FX.onehot_levels(d, ["c"])).orderBy("id").collect()
    assert hot[0]["c_b"] == 1 and hot[1]["c_b"] == 0 and "c_a" not in hot[0].asDict()
    s = FX.robust_scale(d, FX.robust_stats(d, ["z"])).orderBy("id").collect()
    assert [r["z"] for r in s] == [0.0, 0.0, 8.0, 0.0, 0.0]
    assert FX.fill_values(d.select("c", "z")) == {"z": 1.0, "c": "c"}
    assert FX.align_columns(d, ["z", "new"]).columns == ["z", "new"]
    assert FX.cap_categories(d, {"c": ["c"]}).where("c = 'other'").count() == 3


def test_detect_target(spark):
    d = spark.createDataFrame([(1.0, "x", "u", 5), (2.0, "x", "v", 6)], "n double, one string, two string, m int")
    assert FX.detect_target(d.withColumn("Label", F.lit(1)), "regression") == "Label"
    assert FX.detect_target(d.select("one", "two"), "classification") == "two"
    assert FX.detect_target(d, "regression") == "m"
    assert FX.detect_target(d.select("one"), "regression") == "one"
    assert FX.evaluation_target(d.withColumn("y", F.lit(1)), "gone", "classification") == "y"


def test_metrics_edges(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    r = {x["class"]: x for x in E.classification_report(d).collect()}
    assert r["2"]["precision"] == 0.0 and r["2"]["support"] == 1 and r["accuracy"]["precision"] == 0.5
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert E.regression_metrics(flat).first()["r2"] is None
    v = spark.createDataFrame([(1, 2), (1, 1), (2, 3), (2, 3), (2, 1)], "id int, prediction int")
    assert {x[0]: x[1] for x in E.vote_hard(v).collect()} == {1: 1, 2: 3}


def test_silhouette_blocks(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(40, 3)), [i % 3 for i in range(40)]
    d = spark.createDataFrame([(c[i], x[i].tolist()) for i in range(40)], "prediction int, vec array<double>")
    for power, got in ((1, E.silhouette(d, block=7)), (2, E.silhouette_squared(d))):
        s = []
        for i in range(40):
            dist = np.sqrt(((x - x[i]) ** 2).sum(1)) ** power
            own = [dist[j] for j in range(40) if c[j] == c[i] and j != i]
            b = min(np.mean([dist[j] for j in range(40) if c[j] == k]) for k in range(3) if k != c[i])
            s.append((b - np.mean(own)) / max(b, np.mean(own)))
        assert abs(got.first()["silhouette"] - np.mean(s)) < 1e-9


def test_training_learns_and_saves(spark, tmp_path):
    d = tables.synthetic_table(spark, "classification", 400).cache()
    got = MD.train(d, "classification", models=("lr", "nope"), cv=2, options={"lr": {"maxIter": 30}})
    board = {r["model"]: r for r in got.leaderboard.collect()}
    assert board["LR"]["score"] > 0.85 and board["NOPE"]["error"]
    assert got.metrics().first()["below_min"] is False
    path = str(tmp_path / "model")
    got.pipeline().save(path)
    m = MD.evaluate_saved(path, d, got.prepared.rows, "id", "classification").first()
    assert abs(m["accuracy"] - board["LR"]["score"]) < 1e-9
    scored = got.score_raw(d.drop("target"))
    assert scored.where("predicted = '1' and confidence >= 0.5").count() > 50
    reg = MD.train(tables.synthetic_table(spark, "regression", 400), "regression", models=("lr",), cv=0)
    assert reg.score > 0.8
    assert MD.train(d.limit(0), "classification").first()["error"] == "Dataset is empty"
    assert "Unsupported" in MD.train(d, "ranking", "target").first()["error"]


def test_cluster_finds_groups(spark):
    rows = [(float(10 * (i % 2) + (i % 5) / 10), float(i % 3) / 10) for i in range(60)]
    _, metrics, _ = MD.cluster(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], k=2, restarts=2, silhouette="euclidean")
    m = metrics.first()
    assert m["n_clusters"] == 2 and m["kind"] == "euclidean" and m["silhouette_score"] > 0.4


def test_clustering_through_the_driver_takes_text_columns(spark):
    rows = [(i, "x" if i % 2 else "y", float(i % 2)) for i in range(40)] + [(40, None, None)]
    got = MD.train(spark.createDataFrame(rows, "id long, kind string, a double"), "clustering")
    assert got.metrics.first()["n_clusters"] >= 2 and got.rows.count() == 41


def test_stratified_folds_share_out_every_class(spark):
    from siftline.operators import features as FX

    rows = [(i, 0 if i % 10 else 1) for i in range(500)] + [(500 + i, 2) for i in range(3)]
    out = FX.stratified_folds(spark.createDataFrame(rows, "id long, y int"), "id", "y", 5)
    assert out.columns == ["id", "y", "fold"] and out.count() == 503
    per = {(r["y"], r["fold"]): r["count"] for r in out.groupBy("y", "fold").count().collect()}
    for y, n in ((0, 450), (1, 50), (2, 3)):
        sizes = [per.get((y, f), 0) for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_knn_model_counts_repeated_rows(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    train = spark.createDataFrame([(1.0, [0.0])] * 3 + [(0.0, [0.1]), (0.0, [0.2])], "label double, vec array<double>")
    asked = spark.createDataFrame([([0.0],), ([0.0],)], "vec array<double>").select(array_to_vector("vec").alias("features"))
    model = MD.KnnModel(train, 3, "classification")
    assert [r["prediction"] for r in model.transform(asked).collect()] == [1.0, 1.0]
    model.save(str(tmp_path / "knn"))
    again = MD.KnnModel.load(spark, str(tmp_path / "knn"))
    assert [r["prediction"] for r in again.transform(asked).collect()] == [1.0, 1.0]


def test_models_of_every_kind_survive_saving(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 5), "a" if (i % 7) + (i % 5) > 5 else "b") for i in range(140)]
    df = spark.createDataFrame(rows, "id long, x double, y double, target string")
    got = MD.train(df, "classification", "target", models=("lr",), cv=0, ensembles=False)
    train = got.prepared.train.select("label", "vec")
    lr, knn = got.model, MD.KnnModel(train, 3, "classification")
    stacked = MD.Stacking.fit(["lr", "knn"], train, 2, 140, 1, {})
    for i, model in enumerate((lr, knn, MD.Voting([lr, knn], False), stacked)):
        got.model = model
        want = {r["id"]: r["predicted"] for r in got.score_raw(df).collect()}
        got.save(str(tmp_path / str(i)))
        scorer = MD.load_scorer(spark, str(tmp_path / str(i)))
        assert {r["id"]: r["predicted"] for r in scorer.score_raw(df).collect()} == want


def test_fits_at_once_give_the_same_leaderboard(spark):
    d = tables.synthetic_table(spark, "classification", 300).cache()
    small = {"rf": {"numTrees": 5, "maxDepth": 4}, "lr": {"maxIter": 20}}
    boards = []
    for n in (1, 4):
        got = MD.train(d, "classification", models=("rf", "lr", "nope"), cv=3, options=small, parallelism=n)
        boards.append(sorted(tuple(r)[:-1] for r in got.leaderboard.collect()))
        assert [r["model"] for r in got.leaderboard.where("error IS NOT NULL").collect()] == ["NOPE"]
    assert boards[0] == boards[1] and all(b[-2] is not None for b in boards[0] if b[1] in ("RF", "LR"))
    assert MD.at_once([lambda: 1, lambda: 1 / 0, lambda: 3], 2)[::2] == [1, 3]


def test_rows_after_oversampling_are_bounded(spark):
    d = tables.synthetic_table(spark, "classification", 300).withColumn("target", F.when(F.col("id") % 6 == 0, F.col("target")).otherwise(F.lit(0)))
    prep = MD.prepare(d, "target", "classification", "id")
    if len(prep.labels) > 1:
        grown = MD.balanced(prep).count()
        assert MD.balanced(prep, max_rows=100).count() == min(100, grown)


def test_silhouette_writes_each_row_once(spark, monkeypatch):
    # Each row was shuffled once per block; 60 blocks of 5 rows here. Clusters of one row and rows without one count too.
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 2)), [None if i % 50 == 7 else 99 if i == 3 else i % 4 for i in range(300)]
    d = spark.createDataFrame([(c[i], x[i].tolist()) for i in range(300)], "prediction int, vec array<double>")
    plans, plain = [], type(d).agg
    monkeypatch.setattr(type(d), "agg", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self, *a, **k))
    got = E.silhouette(d, block=5).first()
    s = []
    for i in range(300):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = [dist[j] for j in range(300) if c[j] == c[i] and j != i and c[i] is not None]
        others = [np.mean([dist[j] for j in range(300) if c[j] == k]) for k in (0, 1, 2, 3, 99) if k != c[i]]
        a, b = np.mean(own) if own else None, min(others)
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert got["n"] == 300 and abs(got["silhouette"] - np.mean(s)) < 1e-9
    assert plans and not any("FlatMapCoGroups" in p or "Generate" in p for p in plans)
