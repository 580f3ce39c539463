"""Secret scans: three fixed patterns, and automata inferred from what the patterns found.

The patterns give labelled credentials. From at most ``PER_KIND`` of them a kind, those with the
smallest hash (the documented bound), a prefix tree of character classes is built, and its states
are merged where their outgoing frequencies are compatible under the Hoeffding bound (the ALERGIA
rule, with folding). The result is a probabilistic automaton per kind; another one comes from plain
words of the same texts, as background. Every candidate of every text (a run of at least
``LEAST_LENGTH`` credential characters, cut at the spans of the patterns) is then scored, whole, by its log-likelihood per character under each
automaton against the background; the best kind is added if it beats the background by
``margin`` and is about as likely as the credentials it was learnt from.

Spans are code points, end exclusive. Base spans are never dropped; an added span overlaps none.

Edge cases: a null text has no span; without labelled credentials nothing is added; ties between
kinds go to the order assign, access, hex; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialise, travels, worker_cache

travels(__name__)

PER_KIND = 2000
ALPHA = 0.01
MARGIN = 1.0
LEAST_LENGTH, SLICE = 6, 512
VALUES_KEPT, SHORT = 200_000, 40
KINDS = ("assign", "access", "hex")

# Fixed values of the base patterns.
ASSIGN = r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_.=-]{6,}"
LEAST_ASSIGNED = LEAST_LENGTH

_assign, _access, _hex, _candidate = map(re.compile, (ASSIGN, ACCESS, HEX, CANDIDATE))

Span = tuple[int, int, int, int]  # kind, start, end, start of the value


def base_spans(text: str) -> list[Span]:
    """The pattern matches, by kind and start.

    Runs of one character class are matched greedily from their first character, so a length bound
    inside the pattern finds what dropping short runs would leave.
    """
    found: list[Span] = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(0, m.start(), m.end(), m.start(2)) for m in _assign.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if b"akia" in lower:
        found += [(1, m.start(), m.end(), m.start()) for m in _access.finditer(text)]
    return found + [(2, m.start(), m.end(), m.start()) for m in _hex.finditer(text)]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters, and what base spans leave of the runs they touch, in order."""
    out, taken, k = [], sorted((s, e) for _, s, e, _ in base), 0
    for m in _candidate.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        for s, e in takewhile(lambda x: x[0] < m.end(), islice(taken, k, None)):
            if s - at >= LEAST_LENGTH:
                out.append((at, s))
            at = max(at, e)
        if m.end() - at >= LEAST_LENGTH:
            out.append((at, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


# ---- grammar inference -------------------------------------------------------------------------


SYMBOLS = 12
CLASS_SIZE = np.array([6, 20, 6, 20, 10, 1, 1, 1, 1, 1, 1, 1], float)
CLASS_OF = np.full(128, 11, np.int8)
for _i, _chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", *"+/_.=-")):
    CLASS_OF[[ord(c) for c in _chars]] = _i


def symbols(value: str) -> np.ndarray:
    """Character classes: a-f, g-z, A-F, G-Z, digits and each other credential character."""
    return CLASS_OF[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]


class Automaton:
    """A probabilistic automaton over character classes, learnt from example strings."""

    def __init__(self, examples: list[str], alpha: float = ALPHA):
        self.to: list[dict[int, int]] = [{}]
        self.hits: list[dict[int, int]] = [defaultdict(int)]
        self.ends = [0]
        for x in examples:
            at = 0
            for c in symbols(x).tolist():
                self.hits[at][c] += 1
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.to.append({})
                    self.hits.append(defaultdict(int))
                    self.ends.append(0)
                at = self.to[at][c]
            self.ends[at] += 1
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self._tabulate()

    def _seen(self, q: int) -> int:
        return self.ends[q] + sum(self.hits[q].values())

    def _alike(self, a: int, b: int, width: float) -> bool:
        """Are the frequencies of both states, and of all that follows, within the Hoeffding bound?"""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self._seen(p), self._seen(q)
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for c in {*self.hits[p], *self.hits[q]}:
                if abs(self.hits[p].get(c, 0) / n - self.hits[q].get(c, 0) / m) > bound:
                    return False
                if c in self.to[p] and c in self.to[q] and self.to[p][c] != self.to[q][c]:
                    todo.append((self.to[p][c], self.to[q][c]))
        return True

    def _fold(self, red: int, tree: int) -> None:
        """Add the counts of the tree below ``tree`` to the automaton from ``red`` on."""
        todo = [(red, tree)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.hits[q].items():
                self.hits[p][c] += n
                if c in self.to[p]:
                    todo.append((self.to[p][c], self.to[q][c]))
                else:
                    self.to[p][c] = self.to[q][c]

    def _merge(self, width: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.to[0])]
        while blue:
            # The state seen most often is judged first; its frequencies are the surest.
            blue.sort(key=lambda x: (-self._seen(self.to[x[0]][x[1]]), x))
            parent, c = blue.pop(0)
            state = self.to[parent][c]
            same = next((r for r in red if self._alike(r, state, width)), None)
            if same is None:
                red.append(state)
            else:
                self.to[parent][c] = same
                self._fold(same, state)
            known = set(red)
            blue = [(r, c) for r in red for c in sorted(self.to[r]) if self.to[r][c] not in known]
        self.red = red

    def _tabulate(self) -> None:
        """Dense tables: next state and log-probability by state and class, smoothed by class sizes."""
        place = {q: i for i, q in enumerate(self.red)}
        n = len(self.red)
        self.next = np.zeros((n, SYMBOLS), np.int32)
        self.log_p = np.zeros((n, SYMBOLS))
        flat = CLASS_SIZE / CLASS_SIZE.sum()
        for q, i in place.items():
            total = sum(self.hits[q].values())
            for c in range(SYMBOLS):
                self.next[i, c] = place[self.to[q][c]] if c in self.to[q] else 0
                p = (self.hits[q].get(c, 0) + flat[c]) / (total + 1)
                self.log_p[i, c] = math.log(p / CLASS_SIZE[c])
        del self.to, self.hits, self.ends, self.red

    def score(self, values: list[str]) -> np.ndarray:
        """Mean log-likelihood per character of each value, all values in step, by slices that carry the state on."""
        lengths = np.array([len(v) for v in values], np.int64)
        state, total = np.zeros(len(values), np.int64), np.zeros(len(values))
        for begin in range(0, int(lengths.max(initial=0)), SLICE):
            (rows,) = (lengths > begin).nonzero()
            # Longest first, so that those still running are always the first ones.
            rows = rows[np.argsort(-lengths[rows], kind="stable")]
            sizes = np.minimum(lengths[rows] - begin, SLICE)
            coded = symbols("".join(values[i][begin : begin + SLICE] for i in rows))
            starts = np.cumsum(sizes) - sizes
            for j in range(int(sizes[0])):
                at = rows[: np.searchsorted(-sizes, -j, "left")]
                c = coded[starts[: len(at)] + j]
                total[at] += self.log_p[state[at], c]
                state[at] = self.next[state[at], c]
        return total / np.maximum(lengths, 1)


@dataclass
class SecretModel:
    automata: list[tuple[int, Automaton, float]]  # kind, automaton, least score
    background: Automaton | None
    margin: float
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def remembered(self, values: list[str], known: dict[str, int]) -> list[int]:
        """``kinds``, computed once per distinct value; ``known`` keeps short ones, as most are words that recur."""
        if len(known) > VALUES_KEPT:
            known.clear()
        fresh = list({v for v in values if v not in known})
        now = dict(zip(fresh, self.kinds(fresh).tolist()))
        out = [known[v] if v in known else now[v] for v in values]
        known.update((v, k) for v, k in now.items() if len(v) <= SHORT)
        return out

    def kinds(self, values: list[str]) -> np.ndarray:
        """Kind of each value, or -1."""
        out = np.full(len(values), -1)
        if not values or not self.automata:
            return out
        plain = self.background.score(values)
        best = np.full(len(values), -np.inf)
        for kind, automaton, least in self.automata:
            own = automaton.score(values)
            better = (own >= least) & (own - plain >= self.margin) & (own > best)
            out[better], best[better] = kind, own[better]
        return out


# ---- Spark jobs --------------------------------------------------------------------------------


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct credentials of a batch by kind, and words as background (kind -1)."""
    for batch in batches:
        found: set[tuple[int, str]] = set()
        for text in batch["text"]:
            if text:
                base = base_spans(text)
                found.update((k, text[v:e]) for k, _, e, v in base)
                if base:
                    found.update((-1, w) for w in text.split() if len(w) >= 4 and w.isalpha())
        yield pd.DataFrame(sorted(found), columns=["kind", "value"])


def fit(docs: DataFrame, per_kind: int = PER_KIND, margin: float = MARGIN, text: str = "text") -> SecretModel:
    """Infer the automata from the credentials that the patterns find in ``docs``."""
    found = materialise(docs.select(F.col(text).alias("text")).mapInPandas(_labelled, "kind int, value string").distinct(), "credentials")
    sizes = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    # A cut of the hash leaves about twice ``per_kind`` values a kind to be ranked, whatever their number.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (2 * per_kind + 100) / n))] or [F.lit(0), F.lit(0.0)])
    place = F.pmod(F.xxhash64("value"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    by_hash = Window.partitionBy("kind").orderBy(place, "value")
    values = (
        found.where(place < share[F.col("kind")]).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_kind)
        .orderBy("kind", "r").collect()
    )
    by_kind: dict[int, list[str]] = defaultdict(list)
    for r in values:
        by_kind[r.kind].append(r.value)
    words = by_kind.pop(-1, ["the"])
    automata = []
    for kind, examples in sorted(by_kind.items()):
        automaton = Automaton(examples)
        # As likely as all but the oddest hundredth of the examples.
        automata.append((kind, automaton, float(np.quantile(automaton.score(examples), 0.01))))
    return SecretModel(automata, Automaton(words), margin)


def scan(docs: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

    @F.pandas_udf(counted)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        bases, where, values = [], [], []
        known = worker_cache("secret_kinds")
        for i, t in enumerate(texts):
            base = base_spans(t) if t else []
            bases.append([x[:3] for x in base])
            for s, e in candidates(t, base) if t else ():
                where.append((i, s, e))
                values.append(t[s:e])
        added: dict[int, list] = defaultdict(list)
        for (i, s, e), kind in zip(where, shared.value.remembered(values, known.setdefault(shared.value.token, {}))):
            if kind >= 0:
                added[i].append((kind, s, e))
        counts = [[sum(x[0] == k for x in base) for base in bases] for k in range(3)]
        return pd.DataFrame({
            "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base in bases],
            "spans": [joined(base + added[i]) for i, base in enumerate(bases)],
            "n_added": [len(added[i]) for i in range(len(bases))],
        })

    return docs.select(F.col(doc_id).alias("doc_id"), scanned(text).alias("s")).select("doc_id", "s.*")
