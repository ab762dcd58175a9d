"""Name -> query and name -> oracle SQL of the llm problems."""

from __future__ import annotations

from vitagraph.llm import queries as llm_queries


def queries() -> dict:
    return dict(llm_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(llm_queries.ORACLES)
