"""All registered queries."""

from rowtide.plans import (  # noqa: F401  (importing registers)
    alert_queries,
    change_queries,
    relational_queries,
    shaping_queries,
    slowlog_queries,
    source_queries,
    sync_queries,
)
from rowtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
