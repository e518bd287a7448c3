"""Imports every module that registers queries."""

from . import branch_queries, catalog_queries, curation_queries, dataset_queries, evaluation_queries, trace_queries  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
