"""All queries of the engine with their SQL."""

from __future__ import annotations

from taxolith.plans import calls, cells, enrichment, evaluation, experimental, lines, outputs, queries, records  # noqa: F401  each registers its queries
from taxolith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
