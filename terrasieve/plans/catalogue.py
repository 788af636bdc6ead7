"""Every query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from . import evaluation, features, relational, rows, season, shapes, spatial

FLAGSHIP = "season_features"

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (rows, relational, season, evaluation, features, shapes, spatial):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
