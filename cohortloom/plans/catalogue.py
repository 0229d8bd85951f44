"""Imports every query module so that its queries are registered."""

from . import queries_evidence, queries_linear, queries_screen, queries_transfer  # noqa: F401
from .oracle import ORACLE
from .registry import QUERIES

__all__ = ["ORACLE", "QUERIES"]
