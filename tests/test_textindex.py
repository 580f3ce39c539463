"""The kept index of registry texts: results, what a lookup reads, epochs and replays."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import registry as RG
from siftline.operators import similarity as S
from siftline.operators import textindex as TI
from test_matching import sequential, texts

COLUMNS = "seq long, title string, description string, source string, url string, task_type string, dataset_id string"


def posts(spark, rows):
    return spark.createDataFrame([(i, "", t, "s", "u", "regression", None) for i, t in enumerate(rows)], COLUMNS)


def test_epochs():
    assert [TI.epoch_of(b) for b in range(10)] == [0, 1, 2, 2, 4, 4, 4, 4, 8, 8]


def test_batches_one_by_one_equal_the_sequential_rule(spark, tmp_path):
    size = 18
    rows = texts(6 * size, 11, words=7) + [""] * size
    reg = RG.ProblemRegistry(spark, str(tmp_path / "reg"), 0.7)
    for b in range(7):
        reg.register(posts(spark, rows[b * size : (b + 1) * size]), b)
        if b == 3:  # the last batch once more, by a process that starts anew
            RG.ProblemRegistry(spark, str(tmp_path / "reg"), 0.7).register(posts(spark, rows[b * size : (b + 1) * size]), b)
    stride = RG.BATCH_STRIDE
    got = {r["registry_seq"] // stride * size + r["registry_seq"] % stride: r["seen_count"] for r in reg.current().collect()}
    assert got == sequential(rows)


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_lookup_equals_search_in_all_entries(spark, tmp_path, threshold):
    rows = texts(150, 12)
    every = spark.createDataFrame([(i, t, i % 5) for i, t in enumerate(rows)], "registry_seq long, signature string, batch long")
    index = TI.TextIndex(spark, str(tmp_path / "index"), threshold, lambda b: every.where(F.col("batch") < b).drop("batch"), buckets=8)
    for b in range(5):
        index.add(b, every.where(F.col("batch") == b))
    new = spark.createDataFrame([(i, t) for i, t in enumerate(texts(60, 13) + ["", "never seen words"])], "seq long, signature string")
    for before in (5, 3, 1):
        got = {tuple(r) for r in index.best_match(new, before).collect()}
        want = {tuple(r) for r in S.best_match(new, every.where(F.col("batch") < before), threshold, query="seq").collect()}
        assert got == want
    assert index.best_match(new, 0).collect() == []


def test_a_batch_reads_only_the_files_of_its_own_tokens(spark, tmp_path):
    rnd = random.Random(3)
    rows = [" ".join(f"v{rnd.randrange(5000)}" for _ in range(8)) for _ in range(400)]
    every = spark.createDataFrame(list(enumerate(rows)), "registry_seq long, signature string")
    index = TI.TextIndex(spark, str(tmp_path / "index"), 0.9, lambda b: every)
    index.add(1, every.limit(0))
    read = []
    plain = index.read
    index.read = lambda name, batch, buckets: read.append(plain(name, batch, buckets)) or read[-1]
    new = spark.createDataFrame([(0, rows[7])], "seq long, signature string")
    assert [tuple(r) for r in index.best_match(new, 1).collect()] == [(0, 7, 1.0)]
    for df, name in zip(read, ("postings", "texts")):
        every_file = glob.glob(str(tmp_path / f"index/epoch=1/{name}/part=*/bucket=*/*.parquet"))
        assert 0 < len(df.inputFiles()) <= len(every_file) / 6
        assert df.count() < sum(1 for _ in rows)
