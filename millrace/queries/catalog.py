"""All queries over the driver's tables that are not of the training-data subpackage."""

from __future__ import annotations

from millrace.queries import analysis, metrics, records, relational, reports, stored, syntax, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (metrics, relational, analysis, reports, records, texts, stored, syntax):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
