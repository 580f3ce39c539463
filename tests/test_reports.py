import json

from pyspark.sql import functions as F

from siftline.operators import ingest as I
from siftline.operators import runlog as L
from siftline.sources import catalogs, posts, tables
from siftline.streaming import streams


def test_markers_on_the_line_or_below_it(spark):
    lines = [
        "2026-01-15 11:31:31,920 - src - INFO - [Stage 1] Problem Mining", "noise",
        "2026-01-15 11:31:41,920 - src - INFO - ", "[Stage 1 & 1.5] Problem Mining and more",
        "2026-01-15 11:31:51,000 - src - INFO - ", "[Stage 2] ML Feasibility Classification (Secondary Validation)",
        "2026-01-16 00:00:00,500 - src - INFO - Pipeline results saved to x.json", "[Stage 9] not stamped",
    ]
    d = spark.createDataFrame([("r", i, t) for i, t in enumerate(lines)], "run_id string, line_no long, value string")
    m = L.read_markers(d)
    assert [r["stage"] for r in m.orderBy("line_no").collect()] == [
        "Problem Mining", "Problem Mining and more", "ML Feasibility Classification (Secondary Validation)", None]
    lat = {r["stage"]: r["seconds"] for r in L.stage_latency(m).collect()}
    assert lat["Problem Mining"] == 10.0 and lat["ML Feasibility Classification (Secondary Validation)"] == 44_889.5
    assert [r["canonical"] for r in L.mean_latency(L.stage_latency(m)).collect()] == ["feasibility"]


def test_next_value_crosses_buckets(spark):
    d = spark.range(300).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 1000).alias("t"), "id")
    got = {r["id"]: r["nxt"] for r in L.next_value(d, ["k"], "t", "id", "id", "nxt", "hour").collect()}
    assert got == {i: (i + 2 if i + 2 < 300 else None) for i in range(300)}


def test_read_runs_skips_bad_files(spark, tmp_path):
    good = {"run_id": "a", "start_time": "2026-01-01T00:00:00", "end_time": "2026-01-01T00:00:30", "success": True,
            "stages": {"ml_decision": {"success": True, "decisions": [{"decision": "do_not_train"}]}}}
    (tmp_path / "pipeline_results_1.json").write_text(json.dumps(good))
    (tmp_path / "pipeline_results_2.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    runs = L.read_runs(spark, str(tmp_path)).cache()
    tables.write_json(runs, str(tmp_path / "again"))
    assert L.read_runs(spark, str(tmp_path / "again"), "*.json").count() == 1
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "pipeline_results_3.json").write_text(json.dumps(good, indent=1))
    assert L.read_runs(spark, str(tmp_path / "long"), multi_line=True).first()["run_id"] == "a"
    assert runs.count() == 1 and L.run_duration(runs).first()["mean_seconds"] == 30.0
    f = L.success_funnel(runs).first()
    assert (f["total"], f["logic_decision"], f["feasibility"]) == (1, 1, 0)
    g = L.gate_funnel(runs).first()
    assert g["intent_valid"] == -1 and g["approved"] == 0


def test_search_report_stops(spark):
    rows = [(0, i, "do_not_train") for i in range(5)] + [(1, 0, "do_not_train"), (1, 1, "train"), (1, 2, "train")]
    d = spark.createDataFrame(rows, "batch_id int, seq long, decision string")
    assert tuple(streams.search_report(d).first()) == (2, 7, 1, True)
    assert tuple(streams.search_report(d, max_posts=5).first()) == (1, 5, None, False)


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    d.coalesce(1).write.option("header", True).csv(str(tmp_path / "deep" / "one"))
    assert tables.first_csv(spark, str(tmp_path)).count() == 20
    assert tables.csv_tables(spark, str(tmp_path)).count() == 1
    path = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text('[{"id": 1}, {"id": 2}]')
    assert tables.load_table(spark, path, multi_line=True).count() == 2
    assert tables.land_resource(spark, path, str(tmp_path / "csv"), multi_line=True).count() == 2
    tables.write_json(d.coalesce(1), str(tmp_path / "lines.json"))
    assert tables.load_table(spark, str(tmp_path / "lines.json")).count() == 20
    assert tables.import_sampled(spark, str(tmp_path / "deep" / "one"), str(tmp_path / "part"), "id", 5).count() == 5
    assert tables.load_capped(spark, str(tmp_path / "deep" / "one"), "id", 7).count() == 7
    tables.write_json(d, str(tmp_path / "out"), "name")
    assert spark.read.json(str(tmp_path / "out")).count() == 20


def test_sources_edges(spark):
    raw = spark.createDataFrame([(0, "", "nm", None, "x" * 600, [], []), (1, "i", "nm", "T", None, [("PDF", "u")], [("g",)])],
                                "seq long, id string, name string, title string, notes string, resources array<struct<format:string,url:string>>, tags array<struct<name:string>>")
    a, b = catalogs.normalise_catalog(raw, "datagov").orderBy("seq").collect()
    assert a["id"] == "nm" and a["title"] == "nm" and len(a["description"]) == 500 and a["download_url"] is None and a["files"] == []
    assert b["download_url"] == "u" and b["description"] == "" and b["tags"] == ["g"]
    s = spark.createDataFrame([(0, 1, "y" * 120), (1, 2, "short")], "seq long, id int, statement string")
    t = [r["title"] for r in posts.normalise_problems(s, "statement").orderBy("seq").collect()]
    assert t == ["y" * 100 + "...", "short"]
    d = spark.createDataFrame([(0, "a/b", "predict it", "", "", 6.0, 1), (1, "bad", "predict", "", "", 9.0, 99), (2, "c/d", "model", "", "", 1.0, 2)],
                              "seq long, ref string, title string, description string, subtitle string, usability double, download_count long")
    p = posts.normalise_problems(d, "dataset").collect()
    assert [r["id"] for r in p] == ["a/b"] and p[0]["full_text"] == "predict it\n\nML dataset from Kaggle"


def test_keyword_scores(spark):
    q = spark.createDataFrame([(0, ["Heart", "xyz", "heart"]), (1, ["classification-task"]), (2, [])], "query_id int, keywords array<string>")
    c = spark.createDataFrame([(7, ["heart", "disease"]), (8, ["classification"]), (9, ["art"])], "dataset_id int, keywords array<string>")
    got = {(r[0], r[1]): r[2] for r in I.keyword_scores(q, c).collect()}
    assert got == {(0, 7): 2, (0, 9): 2, (1, 8): 1, (2, None): 0}
    top = {(r[0], r[1]): (r[2], r[3]) for r in I.top_entries(I.keyword_scores(q, c), c, 2).collect()}
    assert top == {(0, 7): (2, 1), (0, 9): (2, 2), (1, 8): (1, 1), (2, 7): (0, 1), (2, 8): (0, 2)}


def test_keyword_scores_of_many_queries_without_keywords(spark):
    blank = spark.range(1500).selectExpr("CAST(id AS INT) query_id", "CAST(IF(id % 2 = 0, array(), NULL) AS array<string>) keywords")
    q = blank.unionByName(spark.createDataFrame([(5000, ["heart"])], "query_id int, keywords array<string>"))
    c = spark.createDataFrame([(7, ["heart"]), (8, ["other"]), (8, ["more"])], "dataset_id int, keywords array<string>")
    scores = I.keyword_scores(q, c)
    assert {tuple(r) for r in scores.collect()} == {(i, None, 0) for i in range(1500)} | {(5000, 7, 1)}
    got = {(r[0], r[1], r[2]) for r in I.top_entries(scores, c, 9).collect()}
    assert got == {(i, d, 0) for i in range(1500) for d in (7, 8)} | {(5000, 7, 1)}
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_entries_are_the_top_entries_of_all_scores(spark):
    import random

    rnd = random.Random(7)
    words = ["heart", "art", "disease", "is", "model", "tea", "team", "zzz"]
    q = [(i, [rnd.choice(words).upper() for _ in range(rnd.randint(0, 4))]) for i in range(60)] + [(60, None), (61, ["zz"])]
    q = spark.createDataFrame(q, "query_id int, keywords array<string>")
    c = spark.createDataFrame([(i, rnd.choices(words[:-1], k=rnd.randint(0, 3))) for i in range(80)], "dataset_id int, keywords array<string>")
    for n in (1, 3, 9):
        want = I.top_entries(I.keyword_scores(q, c), c, n).collect()
        assert sorted(tuple(r) for r in I.search_entries(q, c, n).collect()) == sorted(tuple(r) for r in want)


def test_search_of_equal_queries_makes_no_row_per_query_and_entry(spark):
    q = spark.range(2000).selectExpr("id query_id", "array('art') keywords")
    c = spark.range(2000).selectExpr("id dataset_id", "array('heart') keywords")
    seen = []
    first = I.first_per_group
    I.first_per_group = lambda df, *a: seen.append(df.count()) or first(df, *a)
    try:
        assert I.search_entries(q, c, 3).count() == 6000
    finally:
        I.first_per_group = first
    assert max(seen) <= 6000  # a row for every pair would be 4 million


def test_contained_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    short = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(120)})
    long = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(120)})
    got = {tuple(r) for r in I.contained(spark.createDataFrame([(x,) for x in short], "w string"), spark.createDataFrame([(x,) for x in long], "w string")).collect()}
    assert got == {(a, b) for a in short for b in long if a and a in b}


def test_keyword_buckets(spark):
    q = spark.createDataFrame([(0, ["Climate", "x"]), (1, []), (2, None), (3, ["gen", "omics"]), (4, ["a news", "satellite climate"])], "query_id int, keywords array<string>")
    b = spark.createDataFrame([("climate", "c", 0), ("news", "n", 1), ("genomics", "g", 2), ("satellite", "s", 3)], "keyword string, bucket string, place int")
    got = {(r[0], r[1]) for r in I.keyword_buckets(q, b).collect()}
    assert got == {(0, "c"), *((i, x) for i in (1, 2) for x in "cngs"), (4, "c"), (4, "n"), (4, "s")}
    assert {(r[0], r[1]) for r in I.keyword_buckets(q, b, 2).collect()} == {(0, "c"), *((i, x) for i in (1, 2) for x in "cn"), (4, "c"), (4, "n")}


def test_group_limit_runs_before_the_shuffle(spark, sf):
    from siftline.plans.ingest_queries import QUERIES

    plan = QUERIES["hash_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
