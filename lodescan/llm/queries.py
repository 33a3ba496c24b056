"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodescan.llm import q_corpus, q_distinct, q_language, q_lookalike, q_pii, q_sampling

_MODULES = (q_distinct, q_sampling, q_lookalike, q_pii, q_corpus, q_language)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
