"""All registered queries."""

from cuespan.plans import (  # noqa: F401
    align_queries, block_queries, board_queries, dataset_queries, journal_queries, repair_queries, source_queries, stream_queries)
from cuespan.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
