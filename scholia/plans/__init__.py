"""Registered queries over the tables, and the SQL that checks them."""

from .queries import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
