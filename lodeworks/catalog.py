"""The listing queries by name, and their DuckDB equivalents."""

from __future__ import annotations

from .queries import reports, ruling, stateful, texts

_MODULES = (texts, ruling, stateful, reports)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
