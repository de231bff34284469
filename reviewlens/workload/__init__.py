"""Registered queries over the driver tables, each next to the SQL that checks it."""

from . import cleaning, pages, reporting, sentiment, statistics, tables, text, topics  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
