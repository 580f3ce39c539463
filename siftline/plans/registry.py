"""Collects the queries a module registers."""

from __future__ import annotations


def registry():
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return register

    return queries, oracles, query
