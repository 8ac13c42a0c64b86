"""The catalogue of queries: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from quern.plans import analytics, comparisons, corpora, evaluation, evolving, exchange, expressions, files, groundtruth, instances, people, permissions, reports, retrieval, scoring, selections, streams, systems, variants
from quern.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "comparisons", "corpora", "evaluation", "evolving", "exchange", "expressions", "files", "groundtruth", "instances", "people", "permissions", "reports", "retrieval", "scoring", "selections", "streams", "systems", "variants"]
