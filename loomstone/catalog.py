"""Every registered query of the library, and its SQL."""

from loomstone.plans import graph_queries, link_queries, scan_queries, store_queries, text_queries  # noqa: F401  (they register their queries)
from loomstone.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
