"""Registered queries of the engine, outside training-data operators."""

from paperloom.plans import layout, merging, metrics, office, preview, relational, repair, rules, sources, text, windows  # noqa: F401
from paperloom.plans.registry import ORACLE, QUERIES  # noqa: F401
