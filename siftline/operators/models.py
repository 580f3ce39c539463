"""Fit, compare, combine, evaluate and apply models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from math import floor, log2, sqrt

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import evaluate as E
from siftline.operators import features as FX
from siftline.operators.knn import knn_join
from siftline.operators.ranking import sample_exact
from siftline.session import cut

MAX_CLASSES = 1000
MODELS = ("rf", "gbc", "lr", "knn", "svm")
LEADERBOARD = (
    "seq int, model string, score double, accuracy double, precision double, recall double, f1_score double, r2 double,"
    " mse double, cv_mean double, cv_std double, error string"
)


# -- parameters that follow the size of the table ---------------------------


def forest_size(n: int) -> dict[str, int]:
    return {"numTrees": min(100, max(50, n // 500)), "maxDepth": min(20, max(10, int(log2(max(n, 2)))))}


def boosting_size(n: int) -> dict[str, int]:
    return {"maxIter": min(100, max(50, n // 1000)), "maxDepth": min(7, max(3, int(log2(max(n / 10, 1)))))}


def neighbours_for(n: int) -> int:
    return min(10, max(3, floor(sqrt(n))))


def clusters_for(n: int) -> int:
    return min(10, max(2, n // 10))


def folds_for(n: int, fewer_above: int | None = None) -> int:
    """5 folds, or 3 for tables of more than ``fewer_above`` rows."""
    return 3 if fewer_above is not None and n > fewer_above else 5


def models_for(n: int, models: Sequence[str] = MODELS, limit: int | None = None) -> list[str]:
    """All models; with a ``limit``, slow ones are left out of sweeps over more rows."""
    return [m for m in models if limit is None or n <= limit or m in ("lr", "knn", "xgb", "lgbm")]


# -- preparation ------------------------------------------------------------


def _lit(v) -> str:
    return repr(float(v)) + "D" if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


@dataclass
class Prepared:
    """A table ready for training: rows (key, label, vec, is_test) and how to get there."""

    rows: DataFrame
    key: str
    task: str
    expressions: dict[str, str]
    labels: list[str] = field(default_factory=list)

    @property
    def train(self) -> DataFrame:
        return self.rows.where("not is_test")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("is_test")

    def stages(self) -> list:
        """The preparation as pipeline stages that turn a raw table into ``features``."""
        cols = [f"_f{i}" for i in range(len(self.expressions))]
        exprs = ", ".join(f"{e} AS {c}" for e, c in zip(self.expressions.values(), cols))
        return [
            SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"),
            VectorAssembler(inputCols=cols, outputCol="features"),
        ]


def prepare(
    df: DataFrame, target: str, task: str, key: str, test_size: float = 0.2, seed: int = 42,
    max_categories: int = 50, encoding: str = "onehot", max_features: int = 50,
) -> Prepared:
    """Cap and encode categories, split, then fit gaps, selection and scale on the train rows.

    ``encoding`` is "onehot" or "ordinal", for tables of any size.
    """
    if encoding not in ("onehot", "ordinal"):
        raise ValueError(f"unknown encoding {encoding!r}")
    feats = [c for c in df.columns if c not in (target, key)]
    nums = [c for c in FX.numeric_columns(df) if c in feats]
    txts = [c for c in FX.text_columns(df) if c in feats]

    kept = FX.top_categories(df, txts, max_categories)
    capped = FX.cap_categories(df, kept)
    exprs: dict[str, str] = {c: f"CAST({_name(c)} AS DOUBLE)" for c in nums}
    if txts:
        value = {c: _name(c) for c in txts}
        for c, vals in kept.items():
            value[c] = f"CASE WHEN {_name(c)} IN ({', '.join(_lit(v) for v in vals)}) THEN {_name(c)} ELSE 'other' END"
        if encoding == "ordinal":
            for r in FX.category_codes(capped, txts).orderBy("column", "code").collect():
                part = f" WHEN {_lit(r['value'])} THEN {r['code']}.0D"
                exprs[r["column"]] = exprs.get(r["column"], f"CASE coalesce({value[r['column']]}, 'nan')") + part
            exprs = {c: e + " END" if c in txts else e for c, e in exprs.items()}
        else:
            for c, vals in FX.onehot_levels(capped, txts).items():
                for v in vals:
                    exprs[f"{c}_{v}"] = f"CASE WHEN {value[c]} = {_lit(v)} THEN 1.0D ELSE 0.0D END"

    labels: list[str] = []
    label = f"CAST({_name(target)} AS DOUBLE)"
    if task == "classification":
        seen = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(MAX_CLASSES + 1).collect()]
        if len(seen) > MAX_CLASSES:
            raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
        labels = [str(v) for v in seen]
        label = "CASE " + " ".join(f"WHEN {_name(target)} = {_lit(v) if isinstance(v, str) else v} THEN {i}.0D" for i, v in enumerate(seen)) + " END"
    names = list(exprs)
    wide = df.selectExpr(_name(key), f"{label} AS label", *[f"{exprs[f]} AS _f{i}" for i, f in enumerate(names)])
    wide = FX.split(wide, key, "label" if task == "classification" else None, test_size, seed).cache()
    train = wide.where("not is_test")

    cols = [f"_f{i}" for i in range(len(names))]
    med = {c: v[0] or 0.0 for c, v in FX.exact_quantiles(train, cols).items()}
    filled = wide.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in cols})
    ftrain = filled.where("not is_test")
    chosen = FX.select_features(ftrain, cols, "label", max_features) if task == "classification" else cols
    stats = FX.robust_stats(ftrain, chosen)
    final = {
        names[int(c[2:])]: f"(coalesce({exprs[names[int(c[2:])]]}, {_lit(med[c])}) - {_lit(stats[c][0])}) / {_lit(stats[c][1])}"
        for c in chosen
    }
    rows = FX.robust_scale(filled, stats).select(key, "label", F.array(*chosen).alias("vec"), "is_test")
    return Prepared(rows, key, task, final, labels)


def balanced(prep: Prepared, trigger: float = 2.0, max_rows: int | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Train rows (label, vec), grown by SMOTE when the classes are uneven; a sample of ``max_rows`` where that is given."""
    train = prep.train
    if FX.class_balance(train, "label").first()["ratio"] <= trigger:
        return train.select("label", "vec")
    grown = FX.smote(train, prep.key, "label", "vec", k, seed)
    if max_rows is None:
        return grown.select("label", "vec")
    grown = grown.withColumn("_k", F.xxhash64("label", "vec"))
    return sample_exact(grown, "_k", max_rows, seed).select("label", "vec")


# -- models -----------------------------------------------------------------


def few_partitions(df: DataFrame, rows_each: int = 10_000) -> tuple[DataFrame, int]:
    """(cached frame, its rows). Fits run many short jobs, so small tables get few tasks."""
    kept = df.cache()
    n = kept.count()
    have = kept.rdd.getNumPartitions()
    wanted = n // rows_each + 1
    return (kept.coalesce(wanted).cache() if wanted < have else kept), n


def knn_predict(train: DataFrame, test: DataFrame, k: int, task: str = "classification", key: str = "id") -> DataFrame:
    """(key, prediction): majority class (smallest on a tie) or mean of the ``k`` nearest rows.

    ``train``: (id, label, vec); ``test``: (key, vec).
    """
    near = knn_join(test.select(F.col(key).alias("id"), "vec"), train.select("id", "vec"), k)
    voted = near.select("id", F.col("neighbour")).join(train.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    if task == "regression":
        out = voted.groupBy("id").agg(F.avg("label").alias("prediction"))
    else:
        out = E.vote_hard(voted.select("id", F.col("label").alias("prediction")))
    return out.withColumnRenamed("id", key)


class KnnModel:
    """Keeps the train rows, repeated ones too; same ``transform`` as the fitted models.

    Rows are numbered once and written to the shared folder, so their numbers stay. Equal vectors
    to predict share one lookup, under a digest of all their values.
    """

    def __init__(self, train: DataFrame, k: int, task: str):
        self.train = cut(train.select(F.monotonically_increasing_id().alias("id"), "label", "vec"))
        self.k, self.task = k, task

    def transform(self, df: DataFrame) -> DataFrame:
        arr = df.withColumn("_knn_vec", vector_to_array("features")).withColumn("_knn_row", F.sha2(F.to_json(F.struct("_knn_vec")), 256))
        asked = arr.select(F.col("_knn_row").alias("id"), F.col("_knn_vec").alias("vec")).dropDuplicates(["id"])
        pred = knn_predict(self.train, asked, self.k, self.task)
        return arr.join(pred.withColumnRenamed("id", "_knn_row"), "_knn_row").drop("_knn_vec", "_knn_row")

    def save(self, path: str) -> None:
        self.train.withColumns({"k": F.lit(self.k), "task": F.lit(self.task)}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnnModel:
        rows = spark.read.parquet(path)
        head, model = rows.select("k", "task").first(), cls.__new__(cls)
        model.train, model.k, model.task = rows.drop("k", "task"), head.k, head.task
        return model


def estimator(code: str, task: str, n: int, classes: int, seed: int = 42, **over):
    """The estimator for a model code; boosted trees and linear SVM are wrapped for many classes."""
    if task == "regression":
        return {
            "rf": lambda: RandomForestRegressor(seed=seed, **{"numTrees": 100, "maxDepth": 10, **over}),
            "gbc": lambda: GBTRegressor(seed=seed, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **over}),
            "lr": lambda: LinearRegression(**over),
        }[{"xgb": "gbc", "lgbm": "gbc"}.get(code, code)]()
    code = {"xgb": "gbc", "lgbm": "gbc"}.get(code, code)
    if code == "rf":
        return RandomForestClassifier(seed=seed, **{**forest_size(n), **over})
    if code == "lr":
        return LogisticRegression(**over)
    one = (
        GBTClassifier(seed=seed, stepSize=0.1, **{**boosting_size(n), **over}) if code == "gbc"
        else LinearSVC(**{"maxIter": 1000, **over}) if code == "svm" else None
    )
    if one is None:
        raise ValueError(f"unknown model {code!r}")
    return one if classes <= 2 else OneVsRest(classifier=one)


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("vec"))


def fit_one(code: str, train: DataFrame, task: str, classes: int, n: int, seed: int = 42, **over):
    """Fit a model on (label, vec) rows."""
    if code == "knn":
        return KnnModel(train, over.get("k", neighbours_for(n) if task == "classification" else 5), task)
    return estimator(code, task, n, classes, seed, **over).fit(_vectors(train))


def score_of(preds: DataFrame, task: str) -> dict[str, float | None]:
    if task == "regression":
        m = E.regression_metrics(preds).first()
        return {"score": m["r2"], "r2": m["r2"], "mse": m["mse"]}
    m = E.classification_metrics(preds).first()
    return {"score": m["accuracy"], **{c: m[c] for c in ("accuracy", "precision", "recall", "f1_score")}}


def at_once(jobs: Sequence[Callable], most: int) -> list:
    """The results of ``jobs`` in order, ``most`` of them running at a time; a failure is a result too.

    Fits are chains of short Spark jobs, which leave most of a cluster idle when they run one by one.
    """

    def caught(job: Callable):
        try:
            return job()
        except Exception as e:
            return e

    with ThreadPoolExecutor(max(1, most)) as pool:
        return list(pool.map(inheritable_thread_target(caught), jobs))


def raised(result):
    if isinstance(result, Exception):
        raise result
    return result


def with_folds(rows: DataFrame, task: str, k: int) -> DataFrame:
    """(label, vec) rows with their fold, of classes in equal shares for a classification."""
    keyed = rows.withColumn("_k", F.xxhash64("label", "vec"))
    return FX.folds(keyed, "_k", k) if task == "regression" else FX.stratified_folds(keyed, "_k", "label", k)


def fit_fold(code: str, folded: DataFrame, f: int, task: str, classes: int, n: int, seed: int = 42, **over) -> DataFrame:
    """(fold, label, prediction) of fold ``f`` by a model of the others."""
    model = fit_one(code, folded.where(F.col("fold") != f), task, classes, n, seed, **over)
    return model.transform(_vectors(folded.where(F.col("fold") == f))).select("fold", "label", "prediction")


def cross_validate(
    code: str, rows: DataFrame, task: str, classes: int, n: int, k: int, seed: int = 42, parallelism: int = 4, **over
) -> tuple[float, float]:
    """Mean and population deviation of the score over ``k`` folds of (label, vec) rows."""
    folded = with_folds(rows, task, k)
    jobs = [lambda f=f: fit_fold(code, folded, f, task, classes, n, seed, **over) for f in range(k)]
    return fold_summary(code, [raised(p) for p in at_once(jobs, parallelism)], task)


def fold_summary(code: str, folds: Sequence[DataFrame], task: str) -> tuple[float, float]:
    preds = reduce(DataFrame.unionByName, folds)
    metrics = E.regression_metrics(preds, ["fold"]) if task == "regression" else E.classification_metrics(preds, ["fold"])
    scores = metrics.select(F.lit(code).alias("model"), F.col("r2" if task == "regression" else "accuracy").alias("score"))
    r = E.cv_summary(scores).first()
    return r["cv_mean"], r["cv_std"]


@dataclass
class Trained:
    leaderboard: DataFrame
    model: object
    prepared: Prepared
    best: str
    score: float

    def metrics(self, minimum: float = 0.6, goal: float = 0.90) -> DataFrame:
        """One row for the sink: the best model and how it stands to the two marks."""
        return self.leaderboard.where(F.col("model") == self.best).withColumns(
            {"target_achieved": F.col("score") >= goal, "below_min": F.col("score") < minimum}
        )

    def pipeline(self) -> PipelineModel:
        """Preparation and model in one, for saving and scoring raw tables."""
        return PipelineModel(stages=[*self.prepared.stages(), self.model])

    def score_raw(self, df: DataFrame) -> DataFrame:
        ready = Pipeline(stages=self.prepared.stages()).fit(df).transform(df)
        return decode(self.model.transform(ready), self.prepared.labels)

    def save(self, path: str) -> None:
        """Write preparation, model of any kind and class names; ``load_scorer`` reads them."""
        PipelineModel(stages=self.prepared.stages()).write().overwrite().save(f"{path}/preparation")
        save_model(self.model, f"{path}/model")
        spark = self.prepared.rows.sparkSession
        spark.createDataFrame([(list(self.prepared.labels),)], "labels array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


@dataclass
class Clustered:
    rows: DataFrame
    metrics: DataFrame
    model: object


def decode(scored: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Add the class text and, where the model gives one, probability array and confidence."""
    out = scored
    if labels:
        out = out.withColumn("predicted", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1))
    if "probability" in out.columns:
        out = out.withColumn("probabilities", vector_to_array("probability"))
        out = out.withColumn("confidence", F.array_max("probabilities"))
    return out


def align_raw(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add raw columns a scoring table lacks, as NULL, so that they are filled as in training."""
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def train(
    df: DataFrame, task: str, target: str | None = None, key: str = "id", models: Sequence[str] = MODELS,
    cv: int | None = None, ensembles: bool = True, good: float = 0.85, goal: float = 0.90, seed: int = 42,
    options: dict[str, dict] | None = None, parallelism: int = 4, max_rows: int | None = None,
) -> Trained | Clustered | DataFrame:
    """Detect the target, prepare, fit and compare all models, combine the good ones.

    A clustering has no target and gives a ``Clustered`` over all columns but the key. Fits of models and
    folds run ``parallelism`` at a time, with the same results as one by one. ``max_rows`` bounds the
    train rows after oversampling. Returns a ``Trained``; a table that cannot be trained on gives a
    one-row (error) frame.
    """
    spark = df.sparkSession

    def failed(message: str) -> DataFrame:
        return spark.createDataFrame([(message,)], "error string")

    if df.isEmpty():
        return failed("Dataset is empty")
    if task == "clustering":
        return Clustered(*cluster(df, [c for c in df.columns if c != key], seed=seed))
    target = target or FX.detect_target(df.drop(key), task)
    if target is None:
        return failed("Could not detect target column")
    if task not in ("classification", "regression"):
        return failed(f"Unsupported task type: {task}")

    prep = prepare(df, target, task, key, seed=seed)
    rows = balanced(prep, max_rows=max_rows, seed=seed) if task == "classification" else prep.train.select("label", "vec")
    rows, n = few_partitions(rows)
    test = few_partitions(_vectors(prep.test))[0]
    classes = len(prep.labels)
    k = cv if cv is not None else (folds_for(n) if task == "classification" else 5)

    codes = models_for(n, models)
    over = {c: (options or {}).get(c, {}) for c in codes}
    folded = with_folds(rows, task, k) if k > 1 else None

    def whole(code: str) -> tuple[object, dict]:
        model = fit_one(code, rows, task, classes, n, seed, **over[code])
        return model, score_of(model.transform(test), task)

    jobs = [lambda c=c: whole(c) for c in codes]
    jobs += [lambda c=c, f=f: fit_fold(c, folded, f, task, classes, n, seed, **over[c]) for c in codes for f in range(k if k > 1 else 0)]
    done = at_once(jobs, parallelism)
    folds = iter(done[len(codes) :])
    board, fitted = [], []
    for i, (code, result) in enumerate(zip(codes, done)):
        row = {"seq": i, "model": code.upper()}
        own = [next(folds) for _ in range(k)] if k > 1 else []
        try:
            model, scores = raised(result)
            row.update(scores)
            if own:
                row["cv_mean"], row["cv_std"] = fold_summary(code, [raised(p) for p in own], task)
            fitted.append((model, code, row["score"]))
        except Exception as e:  # a model that fails is a row of the leaderboard, not the end of the sweep
            row["error"] = str(e)[:500]
        board.append(row)
    if not fitted:
        return failed("No models could be trained")
    best, name, top = max(fitted, key=lambda t: t[2])
    name = name.upper()

    strong = sorted([f for f in fitted if f[2] > good], key=lambda t: -t[2])
    if ensembles and task == "classification" and len(strong) >= 2:
        tries: list[tuple[str, Callable]] = [
            ("Ensemble", lambda: Voting([m for m, _, _ in strong[:3]], soft=classes == 2)),
            ("Stacking", lambda: Stacking.fit([c for _, c, _ in strong[:2]], rows, classes, n, seed, options or {})),
        ]
        for title, build in tries:
            if top >= goal:
                break
            row = {"seq": len(board), "model": title}
            try:
                m = build()
                row.update(score_of(m.transform(test), task))
                if row["score"] > top:
                    best, name, top = m, title, row["score"]
            except Exception as e:
                row["error"] = str(e)[:500]
            board.append(row)

    cols = [c.split()[0] for c in LEADERBOARD.split(",")]
    table = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in board], LEADERBOARD)
    return Trained(table, best, prep, name, top)


class Voting:
    """Several fitted models: mean probability when all give one, else majority."""

    def __init__(self, models: Sequence, soft: bool):
        self.models, self.soft = list(models), soft

    def transform(self, df: DataFrame) -> DataFrame:
        base = df.withColumn("_row", F.xxhash64(vector_to_array("features")))
        outs = [m.transform(base.select("_row", "features").dropDuplicates(["_row"])) for m in self.models]
        if self.soft and all("probability" in o.columns for o in outs):
            preds = reduce(DataFrame.unionByName, [o.select("_row", vector_to_array("probability").alias("probability")) for o in outs])
            voted = E.vote_soft(preds, "_row")
        else:
            preds = reduce(DataFrame.unionByName, [o.select("_row", "prediction") for o in outs])
            voted = E.vote_hard(preds, "_row")
        return base.join(voted, "_row").drop("_row")


class Stacking:
    """Out-of-fold predictions of base models as features of a logistic regression."""

    def __init__(self, models: Sequence, meta, classes: int):
        self.models, self.meta, self.classes = list(models), meta, classes

    @staticmethod
    def _meta_features(models: Sequence, df: DataFrame, classes: int) -> DataFrame:
        out = df
        for i, m in enumerate(models):
            p = m.transform(out.select("_row", "features").dropDuplicates(["_row"]))
            if "probability" in p.columns:
                vals = vector_to_array("probability")
            else:
                vals = F.transform(F.sequence(F.lit(0), F.lit(max(classes, 2) - 1)), lambda c: (c == F.col("prediction")).cast("double"))
            out = out.join(p.select("_row", vals.alias(f"_m{i}")), "_row")
        return out.withColumn("_meta", array_to_vector(F.concat(*[f"_m{i}" for i in range(len(models))])))

    @classmethod
    def fit(cls, codes: Sequence[str], rows: DataFrame, classes: int, n: int, seed: int, options: dict, k: int = 3) -> Stacking:
        base = FX.stratified_folds(_vectors(rows).withColumn("_row", F.xxhash64("vec")), "_row", "label", k)
        parts = []
        for f in range(k):
            models = [fit_one(c, base.where(F.col("fold") != f).select("label", "vec"), "classification", classes, n, seed, **options.get(c, {})) for c in codes]
            parts.append(cls._meta_features(models, base.where(F.col("fold") == f), classes).select("label", "_meta"))
        meta = LogisticRegression(maxIter=2000, featuresCol="_meta").fit(reduce(DataFrame.unionByName, parts))
        final = [fit_one(c, rows, "classification", classes, n, seed, **options.get(c, {})) for c in codes]
        return cls(final, meta, classes)

    def transform(self, df: DataFrame) -> DataFrame:
        base = df.withColumn("_row", F.xxhash64(vector_to_array("features")))
        return self.meta.transform(self._meta_features(self.models, base, self.classes)).drop("_row", "_meta")


@dataclass
class Scorer:
    """A saved training result: raw tables in, predictions out."""

    preparation: PipelineModel
    model: object
    labels: list[str]

    def score_raw(self, df: DataFrame) -> DataFrame:
        return decode(self.model.transform(self.preparation.transform(df)), self.labels)


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    labels = spark.read.parquet(f"{path}/labels").first()["labels"]
    return Scorer(PipelineModel.load(f"{path}/preparation"), load_model(spark, f"{path}/model"), labels)


def save_model(model, path: str) -> None:
    """Write a fitted model of any kind: plain, nearest neighbours, voting or stacking."""
    spark = SparkSession.active()
    parts = model.models if isinstance(model, (Voting, Stacking)) else []
    kind = {KnnModel: "knn", Voting: "voting", Stacking: "stacking"}.get(type(model), "plain")
    about = (kind, len(parts), getattr(model, "soft", False), getattr(model, "classes", 0))
    spark.createDataFrame([about], "kind string, parts int, soft boolean, classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    for i, part in enumerate(parts):
        save_model(part, f"{path}/part-{i}")
    if kind == "knn":
        model.save(f"{path}/rows")
    elif kind == "stacking":
        save_model(model.meta, f"{path}/meta")
    elif kind == "plain":
        model.write().overwrite().save(f"{path}/fitted")


def load_model(spark: SparkSession, path: str):
    """Read what ``save_model`` wrote."""
    about = spark.read.parquet(f"{path}/about").first()
    parts = [load_model(spark, f"{path}/part-{i}") for i in range(about["parts"])]
    if about["kind"] == "knn":
        return KnnModel.load(spark, f"{path}/rows")
    if about["kind"] == "voting":
        return Voting(parts, about["soft"])
    if about["kind"] == "stacking":
        return Stacking(parts, load_model(spark, f"{path}/meta"), about["classes"])
    return DefaultParamsReader.loadParamsInstance(f"{path}/fitted", spark.sparkContext)


def finalise(df: DataFrame, task: str, target: str, key: str = "id", models: Sequence[str] = ("rf", "lr"), cv: int = 3,
             seed: int = 42, options: dict[str, dict] | None = None) -> tuple[DataFrame, object]:
    """Choose by cross-validated score, then refit the choice on all rows."""
    got = train(df, task, target, key, models, cv=cv, ensembles=False, seed=seed, options=options)
    if isinstance(got, DataFrame):
        return got, None
    best = got.leaderboard.where("error is null").orderBy(F.col("cv_mean").desc_nulls_last(), "seq").first()
    code = best["model"].lower()
    rows, n = few_partitions(got.prepared.rows.select("label", "vec"))
    return got.leaderboard, fit_one(code, rows, task, len(got.prepared.labels), n, seed, **(options or {}).get(code, {}))


def evaluate_saved(path: str, df: DataFrame, prepared_rows: DataFrame, key: str, task: str) -> DataFrame:
    """Metrics of a saved pipeline on the rows its split marked as test."""
    model = PipelineModel.load(path)
    held = prepared_rows.where("is_test").select(key, "label")
    scored = model.transform(df.join(held, key)).select("label", "prediction")
    return E.regression_metrics(scored) if task == "regression" else E.classification_metrics(scored)


def cluster(df: DataFrame, columns: Sequence[str], k: int | None = None, restarts: int = 10, seed: int = 42,
            max_iter: int = 300, silhouette: str = "squared_euclidean", parallelism: int = 4) -> tuple[DataFrame, DataFrame, object]:
    """(rows with prediction, metrics, model): standardised k-means, best of several starts.

    Gaps take the column mean; text columns become 0/1 columns of all levels but the first.
    ``silhouette`` is "squared_euclidean", which is linear in the rows, or "euclidean", which is
    quadratic. The metrics row has the number of clusters that hold rows.
    """
    if silhouette not in ("squared_euclidean", "euclidean"):
        raise ValueError(f"unknown silhouette {silhouette!r}")
    texts = [c for c in FX.text_columns(df) if c in columns]
    columns = [c for c in columns if c not in texts]
    filled = FX.impute_mean(df, columns)
    if texts:
        levels = {f"_{c}_{i}": (c, v) for c, vals in FX.onehot_levels(df, texts).items() for i, v in enumerate(vals)}
        filled = filled.withColumns({n: F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for n, (c, v) in levels.items()})
        columns = [*columns, *levels]
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns], F.count("*").alias("n")).first()
    vec = F.array(*[(F.col(c).cast("double") - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns])
    rows = _vectors(filled.withColumn("vec", vec)).cache()
    k = k or clusters_for(row["n"])
    fits = [raised(m) for m in at_once([lambda i=i: KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(rows) for i in range(restarts)], parallelism)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows)
    found = sum(size > 0 for size in best.summary.clusterSizes)
    sil = E.silhouette(out) if silhouette == "euclidean" else E.silhouette_squared(out)
    metrics = sil.select(F.lit(found).alias("n_clusters"), F.col("silhouette").alias("silhouette_score"), F.lit(silhouette).alias("kind"), "n")
    return out.drop("features"), metrics, best
