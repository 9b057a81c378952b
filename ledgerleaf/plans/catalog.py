"""The registered queries of the engine and the SQL that states their results."""

from __future__ import annotations

from ledgerleaf.plans import artifacts, details, quotations, schemas, transcripts, validation

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (transcripts, quotations, validation, artifacts, details, schemas):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
