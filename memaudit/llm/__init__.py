"""Operators of a training-data pipeline. Nothing else in the package imports this one."""

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
