"""Queries of the reachability engine by name, and their oracle SQL."""

from __future__ import annotations

from . import cycles, documents, facts, packets, reachability, shops, state, stores, trees, wording

MODULES = [reachability, cycles, facts, state, documents, trees, stores, packets, shops, wording]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
