"""Imports every query module so that the registry is complete."""

from . import (  # noqa: F401
    chart_queries, corpus_queries, eval_queries, prep_queries, profile_queries, text_queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
