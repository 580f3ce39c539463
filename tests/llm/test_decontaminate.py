import re
from math import log1p

from siftline.llm import decontaminate as D
from siftline.llm import queries
from siftline.session import load


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w, k=3):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def brute(docs, items, threshold=0.8):
    """All windows of each item's size in each document, by exact weighted similarity."""
    sets = {i: set(grams(words(t))) for i, t in items if words(t)}
    listed = set().union(*sets.values()) if sets else set()
    lengths = {min(3, len(words(t))) for i, t in items if words(t)}
    times = {}
    for _, t in docs:
        w = words(t)
        for k in lengths:
            for g in (tuple(w[i : i + k]) for i in range(len(w) - k + 1)):
                if g in listed:
                    times[g] = times.get(g, 0) + 1
    weight = {g: 1 / (1 + log1p(times.get(g, 0))) for g in listed}
    out = set()
    for n, (d, t) in enumerate(docs):
        w = words(t)
        for i, own in sets.items():
            size, whole = len(words(dict(items)[i])), sum(weight[g] for g in own)
            for s in range(max(1, len(w) - size + 1)):
                if sum(weight[g] for g in own & set(grams(w[s : s + size]))) >= threshold * whole - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_query_finds_what_all_windows_find(spark, sf):
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").where("length(text) < 6000").collect()]
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, sf).collect()}
    small = {d for d, _ in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    here = {(r.doc_id, r.item_id) for r in D.find_matches(table, load(spark, sf, "benchmark")).collect()}
    assert here == brute(docs, items) and here
    assert {x for x in found if x[0] in small} == here


def test_edits_borders_short_items_and_nulls(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    w = item.split()
    filler = " ".join(f"f{i}" for i in range(40))
    edited = " ".join(w[:6] + ["other"] + w[7:])
    docs = [
        (1, f"{filler} {item} {filler}"), (2, item), (3, item.upper().replace(" ", ", ")), (4, f"{filler} {edited} {filler}"),
        (5, f"{filler} {' '.join(w[:12])} {filler}"), (6, f"{' '.join(w[:12])} in between {' '.join(w[12:])}"), (7, None), (8, ""),
        (9, f"go home {filler}"), (10, filler), (None, item), (1, f"{filler} {item} {filler}"), (11, f"{filler} " * 3000 + item), (12, " ".join(w[::-1])),
    ]
    items = [(1, item), (2, "Go home"), (3, None), (4, "?!"), (5, "solo")]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_matches(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got >= brute([d for d in docs if d[0] != 4], items) - {(4, 1)} and got <= brute(docs, items)
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (11, 1), (9, 2)} <= got and not {(5, 1), (10, 1), (12, 1)} & got
    assert [r.start for r in rows if r.doc_id == 1 and r.item_id == 1][0] == 40
    kept = D.drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert D.find_matches(table.limit(0), bench).collect() == [] and D.find_matches(table, bench.limit(0)).collect() == []


def test_index_holds_every_fingerprint_within_the_radius():
    masks = set(D.near_bytes(D.RADIUS // D.BLOCKS))
    assert masks == {m for m in range(256) if m.bit_count() <= 3}
    # 24 bits over 8 bytes leave one byte with 3 at most.
    assert D.RADIUS // D.BLOCKS * D.BLOCKS + D.BLOCKS > D.RADIUS


def test_edited_copies_of_a_passage_that_many_documents_share(spark):
    w = [f"p{i}" for i in range(38)]
    docs = [(i, f"left{i} {' '.join(w)} right{i}") for i in range(150)]
    docs += [(200 + i, f"left{i} {' '.join(w[:i] + [f'other{i}'] + w[i + 1 :])} right{i}") for i in range(38)]
    docs += [(300 + i, f"{' '.join(w[: 4 + i] + [f'in{j}' for j in range(1 + i % 4)] + w[4 + i :])} right{i}") for i in range(30)]
    items = [(1, " ".join(w))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_matches(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(docs, items) and len(got) == len(rows) and {(200 + i, 1) for i in range(38)} <= got
    # The radius alone loses some of them, which is why it is off unless asked for.
    assert {(r.doc_id, r.item_id) for r in D.find_matches(table, bench, radius=D.RADIUS).collect()} == {(r.doc_id, 1) for r in rows if r.bits <= D.RADIUS} < got


def test_query_asks_the_index_and_the_index_finds_edited_hot_passages(spark, sf, monkeypatch):
    asked = []
    index = D.within_radius
    monkeypatch.setattr(D, "within_radius", lambda *a: asked.append(index(*a)) or asked[-1])
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, sf).collect()}
    near = {(r.doc_id, r.item_id) for r in asked[0].collect()}
    assert len(asked) == 1 and len(found & near) >= 0.9 * len(found) > 0
    asked.clear()
    w = [f"p{i}" for i in range(38)]
    docs = [(i, f"left{i} {' '.join(w)} right{i}") for i in range(150)]
    docs += [(200 + i, f"left{i} {' '.join(w[:i] + [f'other{i}'] + w[i + 1 :])} right{i}") for i in range(38)]
    got = D.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    assert got.count() == len(docs) and asked[0].select("doc_id").distinct().count() >= 0.95 * len(docs)


def test_radius_follows_from_the_threshold():
    assert D.radius_for(0.8) == D.RADIUS and D.radius_for(1.0) == 0 and D.radius_for(0.6) > D.RADIUS
