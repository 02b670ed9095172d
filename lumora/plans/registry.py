"""All named queries of the library and the SQL that gives the same rows."""

from lumora.plans import analytics_queries, file_queries, general_queries, ingest_queries, key_queries, library_queries, record_queries, sharing_queries, stream_queries
from lumora.plans.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics_queries", "file_queries", "general_queries", "ingest_queries", "key_queries", "library_queries", "record_queries", "sharing_queries", "stream_queries"]
