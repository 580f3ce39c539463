"""Each stage of the pipeline on what the stage before it kept, against plain versions."""

import corpus_pipeline as P
from llm.test_decontaminate import brute as contaminated
from llm.test_near_dedup import brute as components
from llm.test_token_output import expected as tokens
from siftline.llm import language_id
from siftline.session import load, scratch


def test_stages_and_run(spark, sf):
    docs = load(spark, sf, "documents")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        path = scratch(spark, f"test-stage-{i}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([tuple(r) for r in docs.select("doc_id", *["text"] * (i < 4)).collect()])
        if i < 4:
            assert docs.columns == columns
    identified, unique, clean, mixed, _ = kept

    source = load(spark, sf, "documents")
    model = language_id.fit(source.where(~language_id.held_out()))
    known = {r.doc_id for r in language_id.predict(source, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert {d for d, _ in identified} == known and len(known) >= 0.95 * source.count()
    assert sorted(d for d, _ in unique) == sorted({c for _, _, c in components(identified, 5, 80)})
    short = [(d, t) for d, t in unique if len(t) < 6000]
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    bad = {d for d, _ in contaminated(unique, items)} if len(short) == len(unique) else {d for d, _ in contaminated(short, items)}
    left = {d for d, _ in clean}
    assert bad and not bad & left and {d for d, _ in short} - bad <= left
    assert {d for d, _ in mixed} == left and len(mixed) >= len(clean)
    want = sorted((d, n, crc) for d, _, n, crc in tokens(mixed))
    got = docs.collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got) == [s for _, s, _, _ in tokens(mixed)]
    assert sorted(tuple(r) for r in P.run(spark, sf).collect()) == sorted(tuple(r) for r in got)


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        load(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
