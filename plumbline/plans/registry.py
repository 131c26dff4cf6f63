"""All queries of the library: importing the plan modules registers them."""

from __future__ import annotations

from . import cross, details, ensembles, families, features, labels, mechanisms, models, relations, reports, research, simulations, stores, streams, studies, tables, validation  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
