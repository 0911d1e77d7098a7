"""A small decorator that fills a module's query and oracle tables."""

from __future__ import annotations


def registrar(queries: dict, oracles: dict):
    def query(name: str, sql: str | None = None):
        def wrap(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn
        return wrap
    return query
