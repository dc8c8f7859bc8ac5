"""All registered queries and their oracles, module by module."""

from __future__ import annotations

from quizmill.plans import checks, exchange, generate, ops, questions, retrieve, texts

MODULES = [questions, checks, ops, texts, retrieve, generate, exchange]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
