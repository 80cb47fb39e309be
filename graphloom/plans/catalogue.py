"""All queries over the driver tables, and their SQL."""

from . import competency, corpus_queries, dataset_queries, extraction_queries, graph_queries, parser_queries, record_build_queries, record_queries, schema_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
