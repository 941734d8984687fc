"""Registered queries: each runs an operator of the engine over whole tables."""

from __future__ import annotations

from . import graph, lanes, made, more, phrases, rank, reading, relational, search, stored, texts, vector  # noqa: F401
from .registry import QUERIES, SQL


def all_queries():
    return QUERIES


def all_sql():
    return SQL
