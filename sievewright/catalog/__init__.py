"""Registered queries of the retrieval engine and the SQL that must give the same rows."""

from . import aggregates, analysis, career, etl, evaluation, operations, ranking, resumes, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "analysis", "career", "etl", "evaluation", "operations", "ranking", "resumes", "text"]
