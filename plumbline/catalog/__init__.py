"""The registered queries and the SQL they are compared with."""

from plumbline.catalog.oracle import ORACLE
from plumbline.catalog.registry import QUERIES

__all__ = ["ORACLE", "QUERIES"]
