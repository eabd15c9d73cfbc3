"""The training-data queries by name, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, langid, lexical, licenses, lm_scoring, mixing, near_dedup, pieces, toxicity, vector_codes, warc

MODULES = [exact_dedup, mixing, langid, decontaminate, toxicity, warc, licenses, near_dedup, lm_scoring, html_text, vector_codes, pieces, lexical]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
