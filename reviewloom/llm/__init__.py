"""Operators of a training-data pipeline, one module each, with their queries and SQL.

Functions that run in Python workers travel as code, so the package need not be
installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from reviewloom.llm.registry import oracle_sql, queries  # noqa: E402

__all__ = ["oracle_sql", "queries"]
