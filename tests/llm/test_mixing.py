import hashlib
import math

from siftline.llm import mixing as M
from siftline.llm import queries


def words(text):
    return len((text or "").encode().split())


def shares(rows):
    t, n = {}, {}
    for _, s, text in rows:
        t[s] = t.get(s, 0) + words(text)
    return t


def brute(rows, a, budget, seed=23):
    """Copies of each (doc_id, source) by sorting each source whole."""
    tokens = shares(rows)
    total = sum(tokens.values())
    power = {s: (t / total) ** a if t else 0.0 for s, t in tokens.items()}
    mass, out = sum(power.values()), {}
    if budget == "whole":
        budget = math.ceil(max(tokens[s] / power[s] * mass for s in tokens if tokens[s]))
    for s, t in tokens.items():
        quota = round(power[s] / mass * budget)
        epochs, rest = divmod(quota, t) if t else (0, 0)
        own = sorted((hashlib.md5(f"{seed}:{epochs}:{d}".encode()).hexdigest(), d, words(x)) for d, s2, x in rows if s2 == s)
        held = 0
        for key in dict.fromkeys(k for k, _, _ in own):
            tied = [o for o in own if o[0] == key]
            held += sum(o[2] for o in tied)
            for o in tied:
                out[o[1], s] = epochs + (rest > 0 and held <= rest)
    return {k: v for k, v in out.items() if v}


def copies(df):
    out = {}
    for r in df.collect():
        out[r.doc_id, r.source] = out.get((r.doc_id, r.source), 0) + 1
    return out


def corpus():
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", "w " * (i % 50)) for i in range(900)]
    return rows + [(2000, None, "a b c"), (2001, "empty", ""), (2002, "s1", None), (2003, "one", "x " * 500)]


def test_copies_equal_a_sort_of_each_source(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, epochs int").repartition(4)
    M_rows = M.SLICE_ROWS
    try:
        M.SLICE_ROWS = 16
        for budget in (None, 3000, 60_000, "whole"):
            planned = M.plan(docs, budget, entropy=0.95)
            a = planned.first().exponent
            mixed = M.apply(docs, planned)
            assert mixed.columns == [*docs.columns, "epoch"]
            total = sum(shares(rows).values())
            assert copies(mixed) == brute(rows, a, total if budget is None else budget)
    finally:
        M.SLICE_ROWS = M_rows


def test_exponent_meets_its_target(spark):
    stats = spark.createDataFrame([("a", 9000, 1), ("b", 900, 1), ("c", 100, 1), ("d", 0, 1)], "source string, tokens long, n_docs long")
    p = [0.9, 0.09, 0.01]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    a = M.find_exponent(stats, 10_000, entropy=0.7)
    assert entropy(a) >= 0.7 * math.log(3) > entropy(a + 2e-6)
    a = M.find_exponent(stats, 10_000, most_repeats=4)

    def repeats(a):
        w = [x**a for x in p]
        return max(x / sum(w) / q for x, q in zip(w, p))

    assert repeats(a) <= 4 < repeats(a - 2e-6)
    assert M.find_exponent(stats.limit(1), 10, entropy=0.5) == 1.0 and M.find_exponent(stats.limit(0), 10, entropy=0.5) == 1.0


def test_blocks_hold_every_copy_once_and_fill_their_budgets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", M.word_count("text"))
    planned = M.plan(docs, "whole", entropy=0.95, tokens=docs["n_tokens"])
    mixed = M.apply(docs, planned)
    out = M.blocks(mixed, planned, 4000).collect()
    assert copies(mixed) == {k: sum(r.doc_id == k[0] for r in out) for k in copies(mixed)}
    plan = {r.source: r for r in planned.collect()}
    for s, p in plan.items():
        own = sorted((r for r in out if r.source == s), key=lambda r: (r.epoch, r.start, r.n_tokens))
        at = {}
        for r in own:
            assert r.start >= r.epoch * p.tokens and r.block == math.floor(r.start / (p.weight * 4000.0))
            at[r.epoch] = at.get(r.epoch, 0) + r.n_tokens
        for e in range(p.epochs):
            assert at[e] == p.tokens
        assert sorted(r.start for r in own) == [r.start for r in own]


def test_query_and_edges(spark, sf):
    out = queries.QUERIES["op9_mixing"](spark, sf)
    ids = {r.doc_id for r in out.collect()}
    assert ids == {r.doc_id for r in queries.load(spark, sf, "documents").collect()}
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.apply(empty, M.plan(empty, entropy=0.9)).collect() == []
    assert spark.createDataFrame([(None,), (" a\tb\x0bc ",), ("",)], "text string").select(M.word_count("text").alias("n")).collect() == [(0,), (3,), (0,)]
