"""Registered queries over the shared test tables and their SQL oracles."""

from dyadic.plans.registry import ORACLES, QUERIES  # noqa: F401
from dyadic.plans import catalog as _catalog  # noqa: F401  (registers queries)
