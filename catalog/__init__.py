"""Checked queries: each library operator and plan run on survey-shaped views of the given tables,
next to a SQL statement that computes the same result independently."""

from catalog import basic, domain, exports  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
