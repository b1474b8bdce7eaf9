"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

from lodestone.plans.registry import ORACLES, QUERIES

from lodestone.plans import agreement, audit, checks, design, evidence, fuzzy, markup, probes, recommend, relational, repair, review, streams, texts, workflow  # noqa: F401, I001  register themselves

__all__ = ["ORACLES", "QUERIES"]
