"""Named queries over the given tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from labelloom.plans.catalogue import balancing, evaluation, flows, models, pairing, profiling, vectors

MODULES = [profiling, balancing, pairing, vectors, evaluation, models, flows]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
