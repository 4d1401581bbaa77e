"""Query plans by name; importing the package registers all of them."""

from . import composite, discovery, history, lookups, relational
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composite", "discovery", "history", "lookups", "relational"]
