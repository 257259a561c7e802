"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, mixing, quality, sharding, suffix_dedup, token_counts, token_file, toxicity

_MODULES = (mixing, language_id, sharding, quality, toxicity, decontamination, token_counts, token_file, jaccard_join, suffix_dedup)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
