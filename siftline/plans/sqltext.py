"""Pieces of SQL shared by the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

from siftline.functions import patterns as P
from siftline.functions.text import standing_alone


def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def any_kw(expr: str, vocab: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in vocab) + ")"


def any_word(expr: str, vocab: Sequence[str]) -> str:
    """Single words standing alone, phrases anywhere."""
    parts = [f"contains({expr}, {q(w)})" for w in vocab if " " in w]
    singles = [w for w in vocab if " " not in w]
    if singles:
        parts.append(f"regexp_matches({expr}, {q(standing_alone(singles))})")
    return "(" + " OR ".join(parts) + ")"


def found(expr: str, regexes: Sequence[str], group: int = 1) -> str:
    """List of all matches, pattern by pattern."""
    return "list_concat(" + ", ".join(
        f"regexp_extract_all({expr}, {q('(?i)' + r)}, {group})" for r in regexes
    ) + ")" if len(regexes) > 1 else f"regexp_extract_all({expr}, {q('(?i)' + regexes[0])}, {group})"


def any_re(expr: str, regexes: Sequence[str]) -> str:
    return f"regexp_matches({expr}, {q('(?i)(?:' + '|'.join(regexes) + ')')})"


def trim(expr: str) -> str:
    return f"regexp_replace({expr}, {q(P.TRIM)}, '', 'g')"


def context(expr: str, regexes: Sequence[str], width: int = 50) -> str:
    def one(r: str) -> str:
        full = q(f"(?is)^(.*?)({r})")
        pre = f"length(regexp_extract({expr}, {full}, 1))"
        mid = f"length(regexp_extract({expr}, {full}, 2))"
        start = f"greatest({pre} - {width}, 0)"
        piece = f"substring({expr}, CAST({start} + 1 AS BIGINT), CAST({pre} + {mid} + {width} - {start} AS BIGINT))"
        return f"WHEN regexp_matches({expr}, {q('(?i)' + r)}) THEN {trim(piece)}"

    return "CASE " + " ".join(one(r) for r in regexes) + " END"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(P.SPACE + '+')}), lambda t: t <> '')"


def token_set(expr: str) -> str:
    return f"list_distinct({tokens(f'lower({expr})')})"
