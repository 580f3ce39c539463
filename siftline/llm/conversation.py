"""Repair of damaged conversations: cheapest edits that give every conversation a legal order of roles.

A legal conversation is empty, or an optional system message followed by pairs of user and assistant.
Rows are kept (0), given another role (1) or deleted (2, forced for blank and duplicate rows); messages
without text are inserted (5); a truncated row that stays adds 5. Among the cheapest edits those whose
initials, read in order, come first in ASCII are taken.

1. Rows are range-partitioned and sorted by (conversation, turn, role, text). A task cuts its rows into
   stretches: runs of one conversation, ``ROWS`` rows at most. A conversation that is one stretch and
   touches no edge of its partition is solved where it is; only the others go through steps 2 to 4.
2. Stretches report the first row of each message they hold; repeats in later stretches are marked.
3. Cost DP over four states (nothing yet, after system, after user, after assistant). Each stretch gives
   a 4 x 4 matrix of least costs; the matrices of a conversation, a few numbers per stretch, give the
   cost that is left at the end of each stretch.
4. Each stretch is solved for all four states it may be entered in; states are then passed along.

Within a stretch the least path is found by prefix doubling: every node of the optimal-arc graph is
ranked by the first 1, 2, 4, ... initials of its least path, a rank of 2 m initials being that of the
pair (rank of m, rank of m of the node m arcs on), whose pointer doubles with it. The initials of the
arcs that leave a node differ, so a least prefix has one end node.

``repair`` returns stretches with the repaired messages; ``report`` sums them up per conversation,
``messages`` gives one row per repaired message.

Edge cases: null roles and texts count as one space (so a null text is blank); null conversation ids
are one conversation; null turns come first; rows with one turn are ordered by role and text; equal
rows are duplicates of the first; a conversation without rows left has zeros, an empty audit and no
messages; a gap count beyond a long is cut to the largest long; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise, task_count, travels

travels(__name__)

ROWS = 256
CHARS = 1 << 15
PART_BYTES = 24 << 20
ROWS_AT_ONCE = 1 << 15
CHARS_AT_ONCE = 16 << 20
SPACE = " \t\n\x0b\x0c\r"

#: Costs.
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. The state a system, user or
#: assistant message leads to from each (-1: none), and the role that the state asks for.
AFTER = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ASKED = ("user", "user", "assistant", "user")
NEXT = np.array([2, 2, 3, 2])
FINAL = np.array([0, 2 * INSERT, INSERT, 0])  # cheapest way to end in each state
KINDS = {"s": 0, "u": 1, "a": 2}
KEPT = np.array([AFTER["s"], AFTER["u"], AFTER["a"], (-1, -1, -1, -1)])
LEGAL = {"su", "ua", "au"}
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
END, D, I, K, R = range(5)

COUNTS = "blank long, duplicate long, truncated long, illegal long, distinct_turns long, first_turn string, last_turn string, head string, tail string"
STRETCH = (
    "conv string, part int, no int, whole boolean, kinds binary, marks binary, keys binary, roles array<string>, texts array<string>, "
    f"{COUNTS}, cost long, audit string"
)


# ---- damage ------------------------------------------------------------------------------------


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) of ``rows``, damaged by a hash of conversation and turn.

    A dropped row stays with 0 copies, so that its conversation is not lost; a repeated one has 2.
    """
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    out = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"), kind.alias("kind"),
    )
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


# ---- costs and least paths of a batch of stretches ---------------------------------------------


def row_arcs(kinds: np.ndarray, forced: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and heads of the arcs that use up a row: (rows, 3 edits D K R, 4 states)."""
    n = len(kinds)
    cost, head = np.full((n, 3, 4), FAR), np.zeros((n, 3, 4), np.int64)
    cost[:, 0], head[:, 0] = DELETE, np.arange(4)
    extra = np.where(cut, CUT_OFF, 0)[:, None]
    kept = KEPT[kinds]
    may = (kept >= 0) & ~forced[:, None]
    cost[:, 1], head[:, 1] = np.where(may, extra, FAR), np.maximum(kept, 0)
    cost[:, 2], head[:, 2] = np.where(forced[:, None], FAR, RENAME + extra), NEXT
    return cost, head


def _with_inserts(left: np.ndarray) -> np.ndarray:
    """Least costs to go (last axis: state) if messages may be inserted first."""
    out = left.copy()
    for _ in range(2):  # two inserts at most come between two rows: a third would repeat a state
        out = np.minimum(out, INSERT + out[..., NEXT])
    return out


def costs_to_go(cost: np.ndarray, head: np.ndarray, starts: np.ndarray, lengths: np.ndarray, final: np.ndarray) -> np.ndarray:
    """(rows + stretches, ..., 4): least cost from each node on; ``final`` has (stretches, ..., 4).

    Stretch i has the nodes starts[i] + i to starts[i] + i + lengths[i]. All stretches advance together.
    """
    total = int(lengths.sum()) + len(lengths)
    out = np.zeros((total, *final.shape[1:]), np.int64)
    ends = starts + lengths
    at = ends + np.arange(len(lengths))
    now = final.copy()
    out[at] = now
    for back in range(1, int(lengths.max(initial=0)) + 1):
        (own,) = (lengths >= back).nonzero()
        row = ends[own] - back
        best = None
        for e in range(3):
            heads, costs = head[row, e], cost[row, e]
            if now.ndim == 3:
                heads, costs = np.broadcast_to(heads[:, None], (len(own), 4, 4)), costs[:, None]
            step = costs + np.take_along_axis(now[own], heads, -1)
            best = step if best is None else np.minimum(best, step)
        now[own] = _with_inserts(np.minimum(best, FAR))
        out[at[own] - back] = now[own]
    return out


def least_paths(left: np.ndarray, cost: np.ndarray, head: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray, states: np.ndarray):
    """The least optimal paths from (stretch begin[j], state states[j]): labels, node states, lengths.

    ``left`` are the costs to go at every node, whose stretch ends in whatever state gives them.
    """
    nodes, m = left.shape[0], len(lengths)
    stretch = np.repeat(np.arange(m), lengths + 1)
    last = np.zeros(nodes, bool)
    last[starts + lengths + np.arange(m)] = True
    row = np.minimum(np.arange(nodes) - stretch, max(len(cost) - 1, 0))
    first = np.arange(nodes)[:, None] * 4
    label = np.full((nodes, 4), END, np.int64)
    to = first + np.arange(4)  # the end points to itself
    tries = [(I, np.broadcast_to(np.where(last[:, None], FAR, INSERT), (nodes, 4)), np.broadcast_to(NEXT, (nodes, 4)), 0)]
    if len(cost):
        tries += [(letter, np.where(last[:, None], FAR, cost[row, e]), head[row, e], 4) for letter, e in ((D, 0), (K, 1), (R, 2))]
    flat = np.concatenate([left.ravel(), np.full(4, FAR)])
    for letter, costs, heads, on in sorted(tries, key=lambda x: -x[0]):  # the least letter is set last
        target = first + on + heads
        tight = (costs < FAR) & (costs + flat[np.minimum(target, len(flat) - 1)] == left)
        label[tight], to[tight] = letter, target[tight]
    # Ranks by 1, 2, 4, ... initials; pointers double along.
    rank, pointer, pointers = label.ravel(), to.ravel(), []
    reach = 1
    while True:
        pointers.append(pointer)
        if (rank == END).all() or reach > 3 * (int(lengths.max(initial=0)) + 1):
            break
        _, rank_then = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        done = (pointer[pointer] == pointer).all()
        rank, pointer = rank_then, pointer[pointer]
        reach *= 2
        if done:
            pointers.append(pointer)
            break
    start = (starts[begin] + begin) * 4 + states
    # The length of each path, by pointers that have not come to the end.
    size, at = np.zeros(len(start), np.int64), start.copy()
    flat_label = label.ravel()
    for k in range(len(pointers) - 1, -1, -1):
        ahead = pointers[k][at]
        go = flat_label[ahead] != END
        size[go] += 1 << k
        at = np.where(go, ahead, at)
    size += flat_label[start] != END
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size)
    for k, p in enumerate(pointers):
        on = (step >> k) & 1 == 1
        at[on] = p[at[on]]
    return flat_label[at], at % 4, size


class Batch:
    """Stretches laid out one after the other, with the arcs of their rows."""

    def __init__(self, kinds: list[bytes], marks: list[bytes], final: np.ndarray):
        """``marks``: 1 blank, 2 duplicate, 4 truncated; ``final``: (stretches, 4) costs at their ends."""
        self.lengths = np.array([len(k) for k in kinds], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        every, mark = np.frombuffer(b"".join(kinds), np.uint8), np.frombuffer(b"".join(marks), np.uint8)
        self.cost, self.head = row_arcs(every, (mark & 3) > 0, mark == 4)
        self.final = final

    def matrices(self) -> np.ndarray:
        """(stretches, 4 states on leaving, 4 states on entering): least costs through each stretch."""
        eye = np.where(np.eye(4, dtype=bool), 0, FAR)
        final = np.broadcast_to(eye, (len(self.lengths), 4, 4)).copy()
        left = costs_to_go(self.cost, self.head, self.starts, self.lengths, final)
        return np.minimum(left[self.starts + np.arange(len(self.lengths))], FAR)

    def solve(self, entries: tuple[int, ...]):
        """Cost, letters and states of the least path of each stretch from each entry state."""
        left = costs_to_go(self.cost, self.head, self.starts, self.lengths, self.final)
        m = len(self.lengths)
        begin, states = np.repeat(np.arange(m), len(entries)), np.tile(entries, m)
        label, state, size = least_paths(left, self.cost, self.head, self.starts, self.lengths, begin, states)
        ends = np.cumsum(size)
        total = left[self.starts[begin] + begin, states]
        letters = LETTERS[label].tobytes()
        return [(int(t), letters[e - s : e].decode(), state[e - s : e]) for t, e, s in zip(total, ends, size)]


def apply_edits(letters: str, states: np.ndarray, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The messages that the edits leave."""
    row, who, what = 0, [], []
    for letter, state in zip(letters, states.tolist()):
        if letter == "K":
            who.append(roles[row])
            what.append(texts[row])
        elif letter == "R":
            who.append(ASKED[state])
            what.append(texts[row])
        elif letter == "I":
            who.append(ASKED[state])
            what.append("")
            continue
        row += 1
    return who, what


def exit_state(letters: str, states: np.ndarray, kinds: bytes, entry: int) -> int:
    if not letters:
        return entry
    state, rows = int(states[-1]), sum(x != "I" for x in letters)
    letter = letters[-1]
    return state if letter == "D" else int(KEPT[kinds[rows - 1], state]) if letter == "K" else int(NEXT[state])


# ---- stretches ---------------------------------------------------------------------------------


class Stretch:
    """Rows of one conversation as they come, with their faults."""

    def __init__(self, conv, no: int):
        self.conv, self.no, self.whole = conv, no, False
        self.kinds, self.marks, self.roles, self.texts, self.keys = bytearray(), bytearray(), [], [], []
        self.seen: set[bytes] = set()
        self.illegal, self.turns, self.turn, self.head, self.chars = 0, [], None, None, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        solid = text.rstrip(SPACE)
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        mark = 1 if not solid else 2 if key in self.seen else 4 if solid[-1] not in ".!?" else 0
        self.seen.add(key)
        initial = role[:1]
        self.illegal += bool(self.kinds) and self.last + initial not in LEGAL
        if not self.kinds:
            self.head = initial
        self.last = initial
        self.kinds.append(KINDS.get(initial, 3))
        self.marks.append(mark)
        self.keys.append(key)
        # The text of a row that has to go is not needed any more.
        self.roles.append("" if mark & 3 else role)
        self.texts.append("" if mark & 3 else text)
        self.chars += 0 if mark & 3 else len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def counts(self) -> dict:
        mark = np.frombuffer(bytes(self.marks), np.uint8)
        turns = self.turns
        return {
            "blank": int((mark == 1).sum()), "duplicate": int((mark == 2).sum()), "truncated": int((mark == 4).sum()), "illegal": self.illegal,
            "distinct_turns": len(turns), "first_turn": str(turns[0]) if turns else None, "last_turn": str(turns[-1]) if turns else None,
            "head": self.head, "tail": self.last if self.kinds else None,
        }


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as objects: a null in a column of numbers must not make it one of floats."""
    return pd.DataFrame([[r.get(c) for c in _columns(schema)] for r in rows], columns=_columns(schema), dtype=object)


def _rows(batches: Iterator[pd.DataFrame]):
    for b in batches:
        for conv, turn, role, text, copies in zip(b["conv"], b["turn"], b["role"], b["text"], b["copies"].tolist()):
            yield conv, None if turn is None else int(turn), role, text, copies


def _stretches(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[Stretch]:
    """Stretches in order; those between a partition's first and last conversation may be whole."""
    first, held = True, None
    for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
        if held is not None:
            held.whole = held.no == 0 and not first
            first = False
            yield held
        held = Stretch(conv, 0)
        for _, turn, role, text, copies in group:
            for _ in range(copies):
                if len(held.kinds) >= rows or held.chars > CHARS:
                    yield held
                    held = Stretch(conv, held.no + 1)
                held.add(turn, role, text)
    if held is not None:
        yield held


def _some(stretches: Iterator[Stretch]) -> Iterator[list[Stretch]]:
    held, rows, chars = [], 0, 0
    for s in stretches:
        held.append(s)
        rows, chars = rows + len(s.kinds) + 1, chars + s.chars
        if rows >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield held
            held, rows, chars = [], 0, 0
    if held:
        yield held


def _cut(rows: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for some in _some(_stretches(batches, rows)):
            whole = [s for s in some if s.whole]
            solved = iter(Batch([bytes(s.kinds) for s in whole], [bytes(s.marks) for s in whole], np.tile(FINAL, (len(whole), 1))).solve((0,)))
            out = []
            for s in some:
                row = {"conv": s.conv, "part": part, "no": s.no, "whole": s.whole, **s.counts()}
                if s.whole:
                    cost, letters, states = next(solved)
                    letters, states = with_ending(letters, states, s.kinds)
                    who, what = apply_edits(letters, states, s.roles, s.texts)
                    row |= {"cost": cost, "audit": letters, "roles": who, "texts": what}
                else:
                    row |= {"kinds": bytes(s.kinds), "marks": bytes(s.marks), "roles": s.roles, "texts": s.texts, "keys": b"".join(s.keys)}
                out.append(row)
            yield _frame(out, STRETCH)

    return cut


def with_ending(letters: str, states: np.ndarray, kinds: bytes, entry: int = 0) -> tuple[str, np.ndarray]:
    """A path with the inserts that its end state asks for."""
    state = exit_state(letters, states, bytes(kinds), entry)
    while FINAL[state]:
        letters, states = letters + "I", np.append(states, state)
        state = int(NEXT[state])
    return letters, states


def stretches(rows: DataFrame, limit: int = ROWS) -> DataFrame:
    """The stretches of ``rows`` (conv_id, turn, role, text, copies); whole ones are solved."""
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(task_count(rows.sparkSession, size, PART_BYTES), *order).sortWithinPartitions(*order)
    # Ids and turns travel as text, which keeps all their digits beside nulls.
    dealt = dealt.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "copies")
    return materialise(dealt.mapInPandas(_cut(limit), STRETCH), "stretches")


# ---- conversations of several stretches --------------------------------------------------------

KEY = ["conv", "part", "no"]
FIRSTS = "conv string, part int, no int, place int, k1 long, k2 long"
THROUGH = "conv string, part int, no int, kinds binary, marks binary, blank long, duplicate long, truncated long, costs array<long>"
AHEAD = "conv string, part int, no int, final array<long>"
SOLVED = "conv string, part int, no int, cost long, paths array<string>, exits array<int>, states array<binary>"
CHAINED = f"conv string, part int, no int, roles array<string>, texts array<string>, {COUNTS}, cost long, audit string"


def _same(a: str, b: str, *columns: str) -> Column:
    same = F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    for c in columns:
        same &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return same


def _slices(batches: Iterator[pd.DataFrame], rows: str = "kinds") -> Iterator[pd.DataFrame]:
    """Batches cut to ``ROWS_AT_ONCE`` rows of their stretches."""
    for b in batches:
        at = np.cumsum([len(k) + 1 for k in b[rows]]) // ROWS_AT_ONCE
        for i in range(int(at[-1]) + 1 if len(at) else 0):
            if (at == i).any():
                yield b[at == i]


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each message in each stretch, blank ones left out."""
    for b in _slices(batches, "marks"):
        for conv, part, no, keys, marks in zip(b["conv"], b["part"], b["no"], b["keys"], b["marks"]):
            words = np.frombuffer(keys, "<i8").reshape(-1, 2)
            (own,) = ((np.frombuffer(marks, np.uint8) & 3) == 0).nonzero()
            yield pd.DataFrame({
                "conv": pd.Series([conv] * len(own), dtype=object), "part": part, "no": no, "place": own, "k1": words[own, 0], "k2": words[own, 1],
            })


def _mark_repeats(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``later``: the places of rows whose message an earlier stretch holds."""
    firsts = materialise(pieces.select(*KEY, "keys", "marks").mapInPandas(_exploded, FIRSTS), "message-keys")
    least = firsts.groupBy("conv", "k1", "k2").agg(F.min(F.struct("part", "no")).alias("least"), F.count("*").alias("times")).where("times > 1").alias("l")
    later = firsts.alias("f").join(least, _same("f", "l", "k1", "k2")).where("f.part <> l.least.part OR f.no <> l.least.no")
    # One array per stretch: no more entries than a stretch has rows.
    later = later.groupBy("f.conv", "f.part", "f.no").agg(F.collect_list("f.place").alias("later")).alias("r")
    return pieces.select(*KEY, "kinds", "marks").alias("p").join(later, _same("p", "r", "part", "no"), "left").select("p.*", "r.later")


def _through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats marked, and the cost matrix of each stretch."""
    for b in _slices(batches):
        marks = []
        for m, later in zip(b["marks"], b["later"]):
            mark = np.frombuffer(m, np.uint8).copy()
            if later is not None:
                mark[np.asarray(later, np.int64)] = 2
            marks.append(mark)
        costs = Batch(b["kinds"].tolist(), [m.tobytes() for m in marks], np.zeros((len(b), 4), np.int64)).matrices()
        counted = {c: [int((m == v).sum()) for m in marks] for c, v in (("blank", 1), ("duplicate", 2), ("truncated", 4))}
        yield b.drop(columns="later").assign(marks=[m.tobytes() for m in marks], **counted, costs=[c.ravel().tolist() for c in costs])


def _ahead(group: pd.DataFrame) -> pd.DataFrame:
    """Costs left at the end of each stretch of a conversation: a few numbers per stretch."""
    group = group.sort_values(["part", "no"])
    left, out = FINAL, []
    for costs in reversed(group["costs"].tolist()):
        out.append(left.tolist())
        left = np.minimum((np.array(costs).reshape(4, 4) + left[:, None]).min(0), FAR)
    return group[KEY].assign(final=out[::-1])


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least path of each stretch from each state it may be entered in."""
    for b in _slices(batches):
        solved = Batch(b["kinds"].tolist(), b["marks"].tolist(), np.array(b["final"].tolist(), np.int64).reshape(-1, 4)).solve((0, 1, 2, 3))
        out = []
        for i, (conv, part, no, kinds) in enumerate(zip(b["conv"], b["part"], b["no"], b["kinds"])):
            own = solved[4 * i : 4 * i + 4]
            out.append({
                "conv": conv, "part": part, "no": no, "cost": own[0][0], "paths": [letters for _, letters, _ in own],
                "exits": [exit_state(letters, s, kinds, q) for q, (_, letters, s) in enumerate(own)],
                "states": [s.astype(np.uint8).tobytes() for _, _, s in own],
            })
        yield _frame(out, SOLVED)


def _pass_along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches in order: each takes the path of the state it is entered in."""
    started, conv, state, held = False, None, 0, None

    def ended(row):
        """The last stretch of a conversation, with the messages missing at its end."""
        ending, states = with_ending("", np.array([], np.int64), b"", state)
        who, what = apply_edits(ending, states, [], [])
        return row | {"audit": row["audit"] + ending, "roles": row["roles"] + who, "texts": row["texts"] + what}

    for b in batches:
        out = []
        for row in b.to_dict("records"):
            fresh = not started or row["conv"] != conv
            if held is not None:
                out.append(ended(held) if fresh else held)
            if fresh:
                started, conv, state = True, row["conv"], 0
            letters = row["paths"][state]
            who, what = apply_edits(letters, np.frombuffer(row["states"][state], np.uint8), row["roles"], row["texts"])
            # The cost from the first state is that of the whole conversation.
            held = row | {"audit": letters, "roles": who, "texts": what, "cost": row["cost"] if fresh else 0}
            state = row["exits"][state]
        if out:
            yield _frame(out, CHAINED)
    if held is not None:
        yield _frame([ended(held)], CHAINED)


def _chained(pieces: DataFrame) -> DataFrame:
    """The solved stretches of conversations that are not whole."""
    through = materialise(_mark_repeats(pieces).mapInPandas(_through, THROUGH), "stretch-costs")
    ahead = through.select(*KEY, "costs").groupBy("conv").applyInPandas(_ahead, AHEAD).alias("a")
    solved = through.alias("t").join(ahead, _same("t", "a", "part", "no")).select(*[f"t.{c}" for c in (*KEY, "kinds", "marks")], "a.final")
    solved = solved.mapInPandas(_solve, SOLVED).alias("s")
    carried = [f"p.{c}" for c in _columns(CHAINED) if c not in ("blank", "duplicate", "truncated", "cost", "audit")]
    counted = [f"t.{c}" for c in ("blank", "duplicate", "truncated")]
    joined = pieces.alias("p").join(through.alias("t"), _same("p", "t", "part", "no")).join(solved, _same("p", "s", "part", "no"))
    joined = joined.select(*carried, *counted, "s.cost", "s.paths", "s.exits", "s.states")
    return joined.repartition("conv").sortWithinPartitions(*KEY).mapInPandas(_pass_along, CHAINED)


def repair(rows: DataFrame, limit: int = ROWS) -> DataFrame:
    """Stretches of ``rows`` (conv_id, turn, role, text, copies): ``conv_id``, part and no, counts of faults,
    cost, audit and the repaired roles and texts. ``whole`` stretches are all of their conversation."""
    cut = stretches(rows, limit)
    names = _columns(CHAINED)
    solved = cut.where("whole").select("whole", *names).unionByName(
        materialise(_chained(cut.where("NOT whole")), "chained-stretches").select(F.lit(False).alias("whole"), *names)
    )
    return solved.withColumnRenamed("conv", "conv_id").withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def messages(repaired: DataFrame) -> DataFrame:
    """(conv_id, part, no, place, role, text): one row per repaired message, in that order."""
    both = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.select("conv_id", "part", "no", F.posexplode(both).alias("place", "m")).select("conv_id", "part", "no", "place", "m.role", "m.text")


SUMS = ["blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MOST = (1 << 63) - 1


class _Total:
    """Sums and the digest of one conversation, whose stretches come in order."""

    def __init__(self, conv: str | None):
        self.conv, self.audit, self.sha, self.empty = conv, [], hashlib.sha256(), True
        self.sums = dict.fromkeys(SUMS, 0)
        self.low = self.high = self.tail = None
        self.turns = 0

    def add(self, r: dict) -> None:
        for c in SUMS:
            self.sums[c] += int(r[c])
        if r["head"] is not None:
            self.sums["illegal"] += self.tail is not None and self.tail + r["head"] not in LEGAL
            self.tail = r["tail"]
        if r["first_turn"] is not None:
            first, last = int(r["first_turn"]), int(r["last_turn"])
            self.turns += int(r["distinct_turns"]) - (self.high == first)
            self.low, self.high = first if self.low is None else self.low, last
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"]):
            self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        return {"conv": self.conv, "gaps": gaps, **self.sums, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Totals of conversations whose stretches come in order; one stretch is held at a time."""
    now = None
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            if now is None or now.conv != r["conv"]:
                if now is not None:
                    out.append(now.row())
                now = _Total(r["conv"])
            now.add(r)
        if out:
            yield _frame(out, REPORT)
    if now is not None:
        yield _frame([now.row()], REPORT)


def report(repaired: DataFrame) -> DataFrame:
    """Per conversation: gaps, counts of faults, cost, audit and the digest of the repaired messages."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    low, high = (F.col(c).cast("decimal(38,0)") for c in ("first_turn", "last_turn"))
    gaps = F.least(high - low + 1 - F.col("distinct_turns"), F.lit(MOST).cast("decimal(38,0)"))
    whole = repaired.where("whole").select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *SUMS, "audit", F.sha2(lines, 256).alias("repaired_sha256")
    )
    rest = repaired.where("NOT whole").withColumn("conv", F.col("conv_id").cast("string")).drop("conv_id", "whole")
    rest = rest.repartition("conv").sortWithinPartitions(*KEY).mapInPandas(_totals, REPORT)
    return whole.unionByName(rest.withColumnRenamed("conv", "conv_id").withColumn("conv_id", F.col("conv_id").cast(repaired.schema["conv_id"].dataType)))
