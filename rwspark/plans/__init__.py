"""Registered queries and their SQL."""

from . import committing, corpus, measures, replaying, running, tokenized

_PARTS = (committing, corpus, measures, replaying, running, tokenized)
QUERIES: dict = {}
ORACLE: dict = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
