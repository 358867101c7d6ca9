"""All registered queries of the core, with their SQL where SQL can say the same."""

from __future__ import annotations

from palimpsest.plans import life_queries, more_queries, store_queries, temporal_queries, text_queries

CATALOGUES = (store_queries.C, text_queries.C, life_queries.C, more_queries.C)


def queries() -> dict:
    return {**{k: v for c in CATALOGUES for k, v in c.run.items()}, **temporal_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**{k: v for c in CATALOGUES for k, v in c.sql.items()}, **temporal_queries.oracle_sql()}


FLAGSHIP = text_queries.bm25_episodes
