"""All registered queries; importing the section modules fills the registry."""

from __future__ import annotations

from spantab.plans import (  # noqa: F401
    candidate_queries,
    cleaning_queries,
    feature_queries,
    metric_queries,
    model_queries,
    runlog_queries,
    source_queries,
    split_queries,
)
from spantab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
