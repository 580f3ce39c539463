"""A search that stops: batches until the first fresh post that may be trained on."""

from siftline.operators import registry as RG
from siftline.plans.corpus import STATEMENTS
from siftline.streaming import streams

SCHEMA = "seq long, id string, title string, full_text string, description string, source string"


def row(seq, n, text):
    return (seq, f"p{seq}", f"Item {seq}", f"{STATEMENTS[n]} {text}", text, "s")


def test_search_ends_with_the_first_fresh_approved_post(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [
        [row(0, 0, "known text one two three"), row(1, 2, "a paper"), row(2, 10, "hello")],
        [row(3, 6, "news"), row(4, 1, "something new entirely here"), row(5, 0, "never reached")],
        [row(6, 0, "another one")],
    ]
    registry = RG.ProblemRegistry(spark, str(tmp_path / "reg"))
    known = spark.createDataFrame([(0, "Item 0", "known text one two three", "s", "u", None, None)],
                                  "seq long, title string, description string, source string, url string, task_type string, dataset_id string")
    registry.register(known, 0)
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: streams.post_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    seen = []
    check = registry.check
    registry.check = lambda df, *a, **k: seen.append(1) or check(df, *a, **k)
    got = streams.run_search_stream(stream(), registry, str(tmp_path / "out"), str(tmp_path / "cp"), first_registry_batch=1)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 3, 1, 2, None), (1, 3, 0, 2, 4)]
    calls = len(seen)
    assert {r["registry_seq"] % RG.BATCH_STRIDE for r in registry.entries().collect()} == {0, 4}
    # The third file was not looked at; the next search goes on with it.
    more = streams.run_search_stream(stream(), registry, str(tmp_path / "out2"), str(tmp_path / "cp"), first_registry_batch=1)
    assert [tuple(r) for r in more.collect()] == [(2, 1, 0, 1, 6)] and len(seen) > calls


def test_search_limits(spark, tmp_path):
    src = str(tmp_path / "in")
    for b in range(4):
        spark.createDataFrame([row(2 * b, 10, f"t{b}"), row(2 * b + 1, 10, f"u{b}")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    schema = spark.createDataFrame([], SCHEMA).schema
    for i, limits in enumerate(({"max_batches": 2}, {"max_posts": 3})):
        registry = RG.ProblemRegistry(spark, str(tmp_path / f"reg{i}"))
        got = streams.run_search_stream(streams.post_stream(spark, src, schema), registry, str(tmp_path / f"o{i}"), str(tmp_path / f"c{i}"), **limits)
        assert sorted(tuple(r) for r in got.collect()) == [(0, 2, 0, 2, None), (1, 2, 0, 2, None)]


def test_a_batch_leaves_compressed_tables_and_no_shuffles(spark, tmp_path, monkeypatch):
    """Texts of a batch were checkpointed plain, with their signature as one more copy."""
    text = "a letter about the weather and the garden "
    rows = [(i, f"Item {i}", f"{text * 20}{i}", f"{text * 20}{i}", "s") for i in range(40)]
    posts = spark.createDataFrame(rows, "seq long, title string, full_text string, description string, source string")
    posts.repartition(4).write.parquet(f"{tmp_path}/in")
    names, plain = [], streams.kept
    monkeypatch.setattr(streams, "kept", lambda df, name: names.append((name, "signature" in df.columns)) or plain(df, name))
    registry = RG.ProblemRegistry(spark, f"{tmp_path}/registry")
    stream = streams.post_stream(spark, f"{tmp_path}/in", posts.schema, files_per_batch=9)
    got = streams.run_search_stream(stream, registry, f"{tmp_path}/out", f"{tmp_path}/stream", max_batches=None, max_posts=None).first()
    assert (got.posts, got.skipped) == (40, 0) and names == [("fresh-posts", False)]
