"""Registered queries over the given tables, with the SQL that must give the same rows."""

from . import answers, chunks, compare, cost, evaluation, extraction, privacy, retrieval, risks, store, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
