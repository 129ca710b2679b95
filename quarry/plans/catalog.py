"""Imports every query module so that the registry is filled."""

from quarry.plans import registry
from quarry.plans import (q_clustering, q_market, q_relational, q_retrieval,  # noqa: F401
                          q_scalars, q_sources, q_streaming, q_udf, q_windows)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
