from pyspark.sql import functions as F

from siftline.functions import answers as A
from siftline.functions import text as X
from siftline.operators import triage as T
from siftline.plans.corpus import STATEMENTS

EXPECTED = [
    ("train", "predictive_ml_task"), ("train", "predictive_ml_task"), ("do_not_train", "ml_research_paper"),
    ("do_not_train", "system_design"), ("do_not_train", "research_discussion"), ("do_not_train", "insufficient_information"),
    ("do_not_train", "news_announcement"), ("do_not_train", "personal_experience"), ("do_not_train", "product_discussion"),
    ("do_not_train", "exploratory_analysis"), ("do_not_train", "unknown"), ("do_not_train", "causal_concern"),
    ("do_not_train", "causal_concern"), ("do_not_train", "unjustified_ml"), ("do_not_train", "research_concept"),
    ("do_not_train", "insufficient_information"),
]


def posts(spark, rows, source="web"):
    return spark.createDataFrame([(i, str(i), f"Item {i}", t, source) for i, t in enumerate(rows)],
                                 "seq long, id string, title string, full_text string, source string")


def test_every_branch(spark):
    d = T.triage(posts(spark, STATEMENTS)).orderBy("seq").select("decision.decision", "decision.category", "definition").collect()
    assert [(r[0], r[1]) for r in d] == EXPECTED
    assert d[0]["definition"]["task_type"] == "regression" and d[0]["definition"]["target"] == "price"
    assert d[1]["definition"]["features"] == ["usage and tenure"]
    assert T.first_approved(T.triage(posts(spark, STATEMENTS))).first()["seq"] == 0


def test_word_boundary_and_case(spark):
    d = posts(spark, ["A history of things.", "MY STORY", "Größe und Maß"])
    got = [r[0] for r in T.gate1(d).orderBy("seq").select("intent.category").collect()]
    assert got == ["unknown", "personal_experience", "unknown"]


def test_direct_mode_infers(spark):
    d = posts(spark, ["Customers will churn based on usage, tenure and age.", "Tell me the price."], "direct_input")
    r = T.gate2(d).orderBy("seq").select("feasibility.*").collect()
    assert r[0]["feasible"] and r[0]["target"] == "churn" and r[0]["features"] == ["usage"]
    assert r[1]["target"] == "price" and r[1]["features"] == ["to be extracted from dataset"]


def test_strictness(spark):
    text = ["Predict churn and forecast sales based on usage. The goal is to help with csv data."]
    lax = T.triage(posts(spark, text), strict=False).first()
    assert lax["decision"]["decision"] == "train"


def test_filters_do_not_blow_up_the_plan(spark):
    d = T.approved(T.triage(posts(spark, STATEMENTS)))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
    assert "PythonUDF" not in plan and "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_classify_and_answers(spark):
    d = posts(spark, ["", "We need to predict spam with a model.", "Discussion about a model.", "Nice weather."])
    a = spark.createDataFrame([("1", (True, "clustering", 0.9, ["x"], "r", False)), ("2", (True, "clustering", 0.9, ["x"], "r", False)),
                               ("3", (True, "regression", 0.2, ["x"], "r", False))],
                              "id string, answer struct<feasible:boolean,task_type:string,confidence:double,key_features:array<string>,reasoning:string,is_discussion:boolean>")
    got = {r["id"]: r["ml_classification"] for r in T.classify(d, a).collect()}
    assert got["0"]["confidence"] == 0.0 and got["0"]["feasible"] is False
    assert got["1"]["task_type"] == "clustering" and got["1"]["method"] == "answer"
    assert got["2"]["is_discussion"] and got["2"]["confidence"] == 0.9
    assert got["3"]["task_type"] == "none" and got["3"]["confidence"] == 0.3
    kept = [r["id"] for r in T.filter_feasible(T.classify(d, a)).collect()]
    assert kept == ["1"]


def test_parse_answers(spark):
    rows = ['ok {"feasible": true, "task_type": "Classifier", "confidence": 0.8} end', '{"feasible": true}', "none", "{broken", "}{"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, response_text string")
    got = [r["answer"] for r in A.parse_answers(d, "feasibility").orderBy("i").collect()]
    assert got[0]["task_type"] == "classification" and got[0]["confidence"] == 0.8 and got[1:] == [None] * 4
    base = '"problem_type": "Regression", "target_variable": "y", "input_features": ["a"]'
    texts = [f"{{{base}}}", f'{{{base}, "intended_use": "u"}}', f'{{{base}, "intended_use": "u", "data_source": "d", "evaluation_metric": "m"}}',
             "REJECTED: no", '{"problem_type": "x"}', "prose"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response_text string")
    got = A.parse_answers(d, "canonical").orderBy("i").collect()
    assert [round(r["confidence"], 6) for r in got] == [0.7, 0.8, 1.0, 0.0, 0.0, 0.0]
    assert [r["problem_type"] for r in got] == ["regression", "regression", "regression", "rejected", "invalid", "unknown"]
    texts = ["### ML Problem Title:\nChurn\n\n### Problem Statement:\nFind it.\nMore.", "### ML Problem Title\n\n  Churn \n## problem statement:\nS\n### Target Variable:\ny\n### Input Features:\na",
             "the model " + "x" * 100, "the model", "Not suitable."]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response_text string")
    got = A.parse_answers(d, "sections").orderBy("i").collect()
    assert [round(r["confidence"], 6) for r in got] == [0.8, 1.0, 0.5, 0.0, 0.0]
    assert got[0]["details"]["problem_statement"] == "Find it." and got[1]["details"]["title"] == "Churn"


def test_text_functions(spark):
    r = spark.range(1).select(
        X.slug(F.lit("  Hello, World -- x! ")).alias("slug"), X.repo_slug(F.lit("!!!")).alias("none"),
        X.owner_and_name(F.lit("a/b")).alias("two"), X.owner_and_name(F.lit("a/b/c")).alias("three"),
        X.context_of(F.lit("we USE  it; the goal is clear"), (r"goal\s+is",), 5).alias("ctx"),
        X.next_words(F.lit("The feature age and Variable income input")).alias("next"),
        X.is_question(F.lit("so tell me how")).alias("q"),
    ).first()
    assert r["slug"] == "hello_world_x" and r["none"] == "ml-solution" and r["two"]["name"] == "b" and r["three"] is None
    assert r["ctx"] == "the goal is clea" and r["next"] == ["age", "income"] and r["q"]


def test_where_reaches_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from siftline.session import load

    posts = load(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"),
        F.col("text").alias("description"), F.col("text").alias("full_text"), "source", "lang",
    )
    out = T.triage(posts, where="lang = 'en'")
    plan = out.select("seq", "decision.decision")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and out.count() == posts.where("lang = 'en'").count()
