"""Registered queries: each binds operators to the given tables and has the same rules in SQL."""

from solvara.plans import aggregates, domain, evaluation, further, learning, modelling, panels, portfolio, relational, windows  # noqa: F401
from solvara.plans.registry import ORACLES, QUERIES  # noqa: F401
