import zlib

import pytest

from siftline.llm import queries, sharding
from siftline.session import load, scratch


def lawful(rows, shards, total):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == total
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in load(spark, sf, "documents").collect()}
    out = queries.QUERIES["op8_sharding"](spark, sf)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    lawful(rows, 16, len(docs))
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()
    }


def test_many_buckets_mix_well_and_keep_every_row(spark):
    rows = [(i, f"text {i} " * 20, i % 3) for i in range(2000)] + [(None, None, 1), (None, "x", 1), (7, "again", 2), (7, "again", 2), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int").repartition(3)
    folder = scratch(spark, "shards")
    out = sharding.write_shards(docs, folder, 7, bucket_bytes=20_000)
    got = out.collect()
    lawful(got, 7, len(rows))
    assert sorted(((r.doc_id, r.text, r.bucket) for r in got), key=repr) == sorted(rows, key=repr)
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None and r.doc_id < 2000]
    assert sum(b > a for a, b in zip(ids, ids[1:])) / len(ids) == pytest.approx(0.5, abs=0.06)  # no order is left


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.write_shards(docs, scratch(spark, "shards")).collect() == []
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    lawful(sharding.write_shards(few, scratch(spark, "shards")).collect(), 16, 2)
    with pytest.raises(ValueError):
        sharding.write_shards(few.withColumnRenamed("text", "shard"), scratch(spark, "shards"), text="shard")


def test_the_order_of_arrival_does_not_matter(spark):
    rows = [(i, f"text {i} " * 20, i % 3) for i in range(1000)] + [(None, None, 1), (None, "x", 1), (7, "again", 2), (7, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    placed = []
    for df in (docs.coalesce(1), docs.repartition(5), docs.orderBy(docs.text.desc())):
        out = sharding.write_shards(df, scratch(spark, "shards"), 7, bucket_bytes=8_000)
        placed.append(sorted(map(repr, out.select("doc_id", "text", "shard", "slot").collect())))
    assert placed[0] == placed[1] == placed[2]
