"""All registered queries of the storage-usage engine and their DuckDB equivalents."""

from .plans import fact_queries, function_queries, report_queries, scan_queries, tree_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
