"""Every query by name, and its SQL."""

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
