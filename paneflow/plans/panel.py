"""All panel queries and their DuckDB twins."""

from __future__ import annotations

from paneflow.plans import diagnostics, evaluation, features, graphs, modelling, networks, profiles, ranking, targets  # noqa: F401
from paneflow.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
