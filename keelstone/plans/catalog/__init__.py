"""The registered queries, each beside the SQL that must give the same rows."""

from keelstone.plans.catalog.base import ORACLES, QUERIES
from keelstone.plans.catalog import (  # noqa: F401  (importing registers the queries)
    dimensions,
    facts,
    merges,
    quality,
    rows,
    writes,
)

__all__ = ["ORACLES", "QUERIES"]
