"""All registered queries of the curation and retrieval engine."""

from . import report_queries, retrieval_queries, store_queries, text_queries, upkeep_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
