"""All registered queries and their SQL."""

from __future__ import annotations

from corpusmill.plans import file_queries, registry, text_queries  # noqa: F401  importing registers

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
