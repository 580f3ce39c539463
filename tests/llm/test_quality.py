import re

import numpy as np

from siftline.llm import quality as Q
from siftline.llm import queries
from siftline.session import load


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 3000 else None
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if hit is None else len(hit)]


ODD = ["", None, " \n\t\x0b", "one", "a b c a b c", "a a a a a", "x#y\nx#y\n\n\nx#y ", "é ü ß <b>|</b>", "w " * 49 + "w", "\r\nsame\r\nsame\n"]


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in load(spark, sf, "documents").collect()}
    labels = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    out = queries.QUERIES["op7_quality_rules"](spark, sf)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        got = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]
        assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r.kept == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(good) >= 0.95 * len(good)


def test_statistics_of_odd_texts():
    for t in ODD:
        assert Q.statistics(t)[0] == brute(t), t


def test_edge_tables(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, "w" * 9, 0)] * 2, "doc_id long, text string, kept int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert Q.fit(docs, none) is None
    rows = Q.judge(docs, None).collect()
    assert len(rows) == len(ODD) + 2 and not any(r.kept for r in rows if r.n_words < 50)
    assert Q.judge(docs.limit(0), None).collect() == []


def test_boosting_learns_and_keeps_its_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = Q.boost(x, y, np.array([0, -1, 1]), rounds=30)
    assert (((trees.margin(x) > 0) == y).mean()) > 0.92
    for j, sign in ((1, -1), (2, 1)):
        grid = np.repeat(rng.random((50, 3)), 40, 0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.margin(grid).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    assert len(trees.margin(np.zeros((0, 3)))) == 0
