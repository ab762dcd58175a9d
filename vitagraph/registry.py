"""Name -> query and name -> oracle SQL of the core library."""

from __future__ import annotations

from vitagraph.plans import case_queries, clinical_queries, edge_queries, general_problems, graph_queries, record_queries, score_queries, survey_queries, text_queries, token_queries

FLAGSHIP = "entity_types_texts"
_WITH_ORACLE = {**text_queries.QUERIES, **graph_queries.QUERIES, **clinical_queries.QUERIES, **record_queries.QUERIES, **edge_queries.QUERIES, **token_queries.QUERIES, **case_queries.QUERIES, **survey_queries.QUERIES, **score_queries.QUERIES}


def queries() -> dict:
    """The core's queries; the problems' come first."""
    return {**general_problems.QUERIES, **{k: f for k, (f, _) in _WITH_ORACLE.items()}}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB of the queries that have one."""
    return general_problems.ORACLES | {k: sql for k, (_, sql) in _WITH_ORACLE.items() if sql}
