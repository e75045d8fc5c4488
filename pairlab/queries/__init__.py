"""Queries over the test tables, by operator group, with their SQL."""

from __future__ import annotations

from . import aggregates, composites, inference, io, lexical, relational, scalars, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
