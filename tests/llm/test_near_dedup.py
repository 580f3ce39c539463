"""Near-duplicates against all pairs of the smallest table, and edge cases."""

import re

import pytest

from siftline.llm import near_dedup as N
from siftline.llm import queries
from siftline.session import load


def brute(rows, words, hundredths):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= hundredths * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= hundredths * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    out = queries.QUERIES["op4_near_dedup"](spark, sf)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(rows, 3, 85)


def test_families_chains_and_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)]  # near copies of one text
    chain = [f"c{i}" for i in range(300)]
    rows += [(100 + i, " ".join(chain[8 * i : 8 * i + 200])) for i in range(12)]  # neighbours alike, ends not
    rows += [(200 + i, "Same text here\tand\nthere") for i in range(40)] + [(300, "same TEXT here and there")]
    rows += [(301, "one two"), (302, "One  two"), (303, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(N.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)
    assert got(N.near_duplicates(df)) == brute(rows, 5, 80)


def test_nulls_empty_table_and_other_columns(spark):
    rows = [(1, None, "a"), (None, "some words are here", "b"), (3, "some words are here", "c"), (3, "some words are here", "c"), (5, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, 3, 85).collect()}
    assert out == {(1, 0, 1, True), (None, 2, 3, False), (3, 2, 3, True), (5, 0, 5, True)}
    kept = N.drop_near_duplicates(df)
    assert kept.columns == ["doc_id", "text", "node"] and {r.doc_id for r in kept.collect()} == {1, 3, 5}
    assert N.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_bands_miss_almost_nothing(threshold):
    n = N.band_count(threshold)
    assert (1 - threshold**N.ROWS) ** n <= 1e-7


def test_one_row_of_each_group_is_kept_whatever_its_id(spark):
    alone = "a text of its own that nobody else has written down here"
    shared = "this text was copied many times under a single document id"
    rows = [(None, f"{alone} {i} {i} {i} {i} {i} {i} {i}") for i in range(5)] + [(7, shared)] * 6 + [(7, "a very different text under the same id as the copies")]
    rows += [(8, shared), (None, shared), (None, None), (None, None), (9, "")]
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = sorted([r for r in rows if r[0] is None and (r[1] is None or r[1] != shared)] + [(7, shared), rows[11], (9, "")], key=str)
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == want
