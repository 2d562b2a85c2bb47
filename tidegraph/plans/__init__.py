"""All queries of the library, by name."""

from . import graph_queries, io_queries, post_queries  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES  # noqa: F401
