"""Queries over the benchmark tables and the SQL they are checked against."""

from reviewloom.workload.oracle import oracle_sql
from reviewloom.workload.queries import queries

__all__ = ["oracle_sql", "queries"]
