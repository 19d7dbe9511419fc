"""All registered queries of the core operators and their DuckDB SQL."""

from __future__ import annotations

from loamline.plans import catalog, checks, corpus, filings, linting, reuse, runs  # noqa: F401
from loamline.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
