"""Every operator as a query over the sample tables, by the names of the inventory."""

from jobquarry.queries import html_side, io_side, quality_side, search_side, url_side  # noqa: F401
from jobquarry.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
