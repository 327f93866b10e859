"""All registered queries of the assessment operators, with their SQL."""

from __future__ import annotations

from quillmark.plans import queries_documents, queries_grading, queries_history, queries_matching, queries_results
from quillmark.plans.entries import ORACLES, QUERIES

MODULES = (queries_results, queries_grading, queries_matching, queries_documents, queries_history)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
