"""All registered queries: importing the modules registers them."""

from . import contract_queries, gold_queries, lakehouse_queries, publication_queries, series_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contract_queries", "gold_queries", "lakehouse_queries", "publication_queries", "series_queries", "text_queries"]
