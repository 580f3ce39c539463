"""What keeps the text join small: the order of tokens, containment, bitmaps."""

import random

from pyspark.sql import functions as F

from siftline.operators import setjoin as J
from siftline.operators import similarity as S


def sets(spark, rows):
    df = spark.createDataFrame([(i, i, t, len(t)) for i, t in enumerate(rows)], "k long, first long, low string, chars int")
    return df.withColumn("toks", F.array_distinct(F.split("low", " ")))


def test_rare_words_come_before_common_ones_in_a_large_vocabulary(spark):
    # 100,000 words that come once, and 50 that come 40 times: each of the latter is last in its set.
    rows = [f"common{i % 50} " + " ".join(f"w{i}x{j}" for j in range(50)) for i in range(2000)]
    df = sets(spark, rows)
    table = J.rarity(df)
    last = J.prefixes(df, table, F.lit(1e-6)).groupBy("k").agg(F.max(F.struct("pos", "t")).alias("x")).select("k", "x.t")
    common = df.select("k", F.xxhash64(F.get("toks", F.lit(0))).bitwiseAND(F.lit((1 << 56) - 1)).alias("h"))
    right = last.join(common, "k").where(F.col("t").bitwiseAND(F.lit((1 << 56) - 1)) == F.col("h")).count()
    assert right >= 1800


def test_texts_within_others_are_found_and_bitmaps_lose_none(spark):
    rnd = random.Random(5)
    longs = [" ".join(f"v{rnd.randrange(300)}" for _ in range(rnd.randint(4, 40))) for _ in range(60)]
    rows = longs + [t[rnd.randrange(3) : len(t) - rnd.randrange(3)] for t in longs] + [t[len(t) // 3 :] for t in longs] + ["v1", "1"]
    rows = sorted(set(rows))
    df = sets(spark, rows)
    words = [set(t.split(" ")) for t in rows]
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a in b and len(words[i] & words[j]) >= 0.5 * len(words[i] | words[j])}
    found = J.within(df, df, 0.5, J.rarity(df)).toDF("lk", "rk")
    assert want <= {tuple(r) for r in found.collect()}
    maps = J.bitmaps(df)
    assert want <= {tuple(r) for r in J.near_bitmaps(found, maps, maps, 0.5, "l").collect()}


def test_what_is_written_for_a_join_grows_like_the_texts(spark, monkeypatch):
    # 400 texts of 60 words that share their common words only: nearly none may be scored.
    rnd = random.Random(6)
    rows = [" ".join([f"c{j}" for j in rnd.sample(range(60), 40)] + [f"r{rnd.randrange(2000)}" for _ in range(20)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows + [rows[0] + " more"])), "id long, signature string")
    scored, plain = [], S.score_pairs
    monkeypatch.setattr(S, "score_pairs", lambda pairs, *a, **k: scored.append(pairs.count()) or plain(pairs, *a, **k))
    reg = df.withColumnRenamed("id", "registry_seq")
    got = {(r["id"], r["registry_seq"]) for r in S.best_match(df, reg, 0.7).collect()}
    assert got == {(i, i) for i in range(400)} | {(400, 0)}  # the first text lies in the last one
    assert scored[0] <= 2 * 401


def test_words_on_one_side_only_multiply_no_pairs(spark, monkeypatch):
    # 300 entries that differ in words no post has, 40 posts that differ in words no entry has.
    rnd = random.Random(7)
    ps = [(i, f"post{i} churn based on the usage of data {'x' * (i % 3)}") for i in range(40)] + [(40, "nothing alike"), (41, "")]
    ds = [(i, f"entry{i} b{rnd.randrange(50)} dataset for churn based on usage") for i in range(300)] + [(300, ""), (301, "data of the usage")]
    scored, plain = [], J.verify
    monkeypatch.setattr(J, "verify", lambda pairs, *a, **k: scored.append(pairs.count()) or plain(pairs, *a, **k))
    p, d = spark.createDataFrame(ps, "problem_id long, match_text string"), spark.createDataFrame(ds, "dataset_id long, match_text string")
    terms = ("data", "usage")
    got = sorted((r[0], r[1], round(r[2], 9), r[3]) for r in S.match(p, d, threshold=0.3, terms=terms).collect())
    want = []
    for i, a in ps:
        best = []
        for j, b in ds:
            x, y = set(a.split()), set(b.split())
            sim = (len(x & y) / len(x | y) if x | y else 0.0) + sum(0.1 for t in terms if t in a and t in b)
            best.append((-min(1.0, sim), j))
        want += [(i, j, round(-s, 9), n) for n, (s, j) in enumerate(sorted(best)[:3], 1) if -s >= 0.3 or n == 1]
    assert got == sorted(want)
    assert sum(scored) <= 60


def test_pairs_scored_in_rounds_clear_their_shuffles(spark, tmp_path, monkeypatch):
    # 30 copies of a long text with a word of their own: 900 pairs carry 30 times the texts.
    long = " ".join(f"w{j}" for j in range(200))
    rows = [(i, f"{long} own{i}") for i in range(30)] + [(30, f"{long[: len(long) // 2]}"), (31, "")]
    df = spark.createDataFrame(rows, "id long, signature string")
    reg = df.withColumnRenamed("id", "registry_seq")
    once = sorted(map(tuple, S.best_match(df, reg, 0.7).collect()))
    names, plain = [], S.kept
    monkeypatch.setattr(S, "kept", lambda d, name="kept": names.append(name) or plain(d, name))
    monkeypatch.setattr(S, "ROUND_CHARS", 1)
    assert sorted(map(tuple, S.best_match(df, reg, 0.7).collect())) == once
    assert 5 < names.count("scored-pairs") < 40
