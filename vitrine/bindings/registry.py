"""Collects the query and oracle tables of every binding module."""

from __future__ import annotations

import functools
import importlib

from vitrine.session import ship_package

MODULES = ["scalars", "pricing", "ledger", "timeline", "matching", "fingerprint", "frames", "evaluation", "files", "streams", "composites"]


def _load():
    for name in MODULES:
        yield importlib.import_module(f"vitrine.bindings.{name}")


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    out: dict = {}
    for module in _load():
        for name, fn in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = _shipped(fn)
    return out


def oracles() -> dict:
    out: dict = {}
    for module in _load():
        out.update(module.ORACLES)
    return out
