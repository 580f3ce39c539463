import hashlib
import heapq
import random
import re
import zlib

import numpy as np

from siftline.llm import conversation as C
from siftline.llm import queries
from siftline.session import load

NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """(turn, role, text) per conversation after damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def cheapest(rows):
    """The least (cost, audit) over all edits, by best-first search on whole audits, and its messages.

    The roles asked for are told by the number of messages before and whether a system message leads.
    """
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, got = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, got
        asked = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, asked[0], (*got, (asked, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, got))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, asked[0], (*got, (asked, text))))
                if role[:1] == asked[0] or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*got, (role, text))))


def brute(rows):
    out = {}
    for conv, own in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, got = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        out[conv] = [
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest(),
        ]
    return out


def table(df):
    rows = df.collect()
    out = {r.conv_id: [r[c] for c in NAMES] for r in rows}
    assert len(out) == len(rows)
    return out


def source(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kinds string, part int")


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert table(queries.QUERIES["op12_conversation_repair"](spark, sf)) == brute(rows)


def mixed(rng, convs, most):
    rows = []
    for c in range(convs):
        n = rng.randint(1, most)
        for t in range(n):
            rows.append((
                None if c == 3 else c, rng.choice([t, t, t, t + 2, None, 7]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                rng.choice(["Well.", "So what?", "cut off", "", " \t", "Yes! \n", None, f"number {rng.randint(0, 9)}."]),
            ))
    return rows + rows[::7]


def test_stretches_of_any_length_give_the_same(spark):
    rows = mixed(random.Random(5), 60, 12)
    want = brute(rows)
    for limit in (1, 3, 256):
        repaired = C.repair(C.damage(source(spark, rows)), limit)
        assert table(C.report(repaired)) == want
    # One row per repaired message; a conversation's texts are those of its digest.
    got = {}
    for r in C.messages(repaired).orderBy("part", "no", "place").collect():
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == row[-1]


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}!"])) for t in range(3000)]
    rows += [(1 << 60 | c, t, "user", "Hello there.") for c in range(40) for t in (0, (1 << 62) + 1)]
    assert table(C.report(C.repair(C.damage(source(spark, rows)), 64))) == brute(rows)


def test_least_paths_equal_greedy_search():
    """Doubled pointers against a walk that always takes the least initial that keeps the cost."""
    rng = np.random.default_rng(2)
    kinds = [rng.integers(0, 4, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 40, 3, 200)]
    marks = [rng.choice([0, 0, 1, 2, 4], len(k)).astype(np.uint8).tobytes() for k in kinds]
    final = rng.integers(0, 12, (len(kinds), 4))
    batch = C.Batch(kinds, marks, final)
    left = C.costs_to_go(batch.cost, batch.head, batch.starts, batch.lengths, final)
    for i, (cost, letters, states) in enumerate(x for x in batch.solve((0, 1, 2, 3))):
        s, q = divmod(i, 4)
        row, end, want = int(batch.starts[s]), int(batch.starts[s] + batch.lengths[s]), ""
        assert cost == left[row + s, q]
        while row < end:
            here = left[row + s, q]
            arcs = [(x, batch.cost[row, e, q], batch.head[row, e, q], 1) for x, e in (("D", 0), ("K", 1), ("R", 2))] + [("I", 5, C.NEXT[q], 0)]
            x, _, q, on = min(a for a in arcs if a[1] + left[row + a[3] + s, a[2]] == here)
            want, row = want + x, row + on
        assert letters == want


def test_edge_tables(spark):
    assert C.report(C.repair(C.damage(source(spark, [])))).collect() == []
    dropped = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, dropped, "user", "Hello."), (2, None, None, None), (None, None, "user", "x" * 200_000)]
    got = table(C.report(C.repair(C.damage(source(spark, rows)))))
    assert got == brute(rows)
    assert got[1] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
