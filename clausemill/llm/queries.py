"""All queries of the subpackage, in the order of the operators."""

from . import queries_alignment, queries_audit, queries_decontamination, queries_disclosure, queries_language, queries_lines, queries_near, queries_quality, queries_revisits, queries_tokens, queries_toxicity, queries_urls  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
