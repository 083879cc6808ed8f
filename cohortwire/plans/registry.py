"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from . import query_features, query_mapping, query_models, query_streaming, query_tables

_PARTS = (query_mapping, query_features, query_tables, query_models, query_streaming)


def queries():
    return {name: q for part in _PARTS for name, q in part.REGISTER.queries.items()}


def oracle_sql():
    return {name: q for part in _PARTS for name, q in part.REGISTER.sql.items()}
