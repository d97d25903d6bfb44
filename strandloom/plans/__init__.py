"""Registered queries and the SQL that must give the same rows."""

from . import kmers, navigation, packing, varorder


def queries() -> dict:
    return {k: q for m in (packing, kmers, navigation, varorder) for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in (packing, kmers, navigation, varorder) for k, q in m.SQL.items()}
