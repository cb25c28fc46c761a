"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from conceptflow.llm import decontaminate, licenses, neighbours, packing, quality, secrets, sharding, simhash, substrings, toxicity

_MODULES = (simhash, substrings, quality, decontaminate, toxicity, secrets, licenses, sharding, packing, neighbours)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
