"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from folioscope.plans import evidences, fullrecords, graphs, impact, lookups, maps, matching, pagelayouts, papers, passages, reading, records, regions, rendering, store, texts, trends, upkeep, vectors, ways  # noqa: F401  each adds its queries
from folioscope.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
