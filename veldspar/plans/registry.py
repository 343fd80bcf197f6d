"""The modules whose QUERIES and ORACLES are registered."""

from __future__ import annotations

from types import ModuleType


def modules() -> list[ModuleType]:
    from veldspar.plans import audit, context, extraction, graphs, impact, problems, relational, resolver, review, texts

    return [problems, graphs, relational, texts, extraction, impact, resolver, review, context, audit]
