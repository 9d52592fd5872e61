"""Registered queries and their SQL."""

from . import enrich, media, more, records, search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (search, media, records, enrich, more):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
