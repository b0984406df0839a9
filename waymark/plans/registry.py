"""Queries of the library by name, with their SQL."""

from __future__ import annotations

import functools

from . import feature_oracles, oracles, process_queries, queries, release_queries, sketch_queries, source_queries, state_queries, stream_queries, temporal_queries, workflow_queries

FLAGSHIP = "pair_accuracy_by_group"
_REGISTERS = (source_queries.query, process_queries.query, state_queries.query, stream_queries.query, temporal_queries.query, sketch_queries.query, release_queries.query, workflow_queries.query)
QUERIES = functools.reduce(dict.__or__, [queries.QUERIES, *(r.queries for r in _REGISTERS)])
#: All SQL but that of action_similarity, which takes a second to make.
ORACLE = functools.reduce(dict.__or__, [oracles.ORACLE, feature_oracles.ORACLE, *(r.oracle for r in _REGISTERS)])


@functools.cache
def oracle() -> dict[str, str]:
    return ORACLE | {"action_similarity": feature_oracles.similarity()}


__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "oracle"]
