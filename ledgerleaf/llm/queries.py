"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from ledgerleaf.llm import queries_bytes, queries_corpus, queries_models, queries_native, queries_spans

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_native, queries_bytes, queries_models, queries_corpus, queries_spans):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
