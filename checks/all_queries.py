"""Import every group of queries so that the registry is complete."""

from checks import clean_queries, job_queries, mart_queries, merge_queries, quality_queries, source_queries, view_queries  # noqa: F401
from checks.registry import ORACLE, QUERIES  # noqa: F401
