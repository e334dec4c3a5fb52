"""Every operator as a query over the driver tables, with an independent SQL twin."""

from larder.registry.base import ORACLES, QUERIES, Fixture, oracle_text
from larder.registry import (  # noqa: F401  (modules fill the registries)
    aggregate_queries,
    inventory_queries,
    model_queries,
    relational_queries,
    source_queries,
    streaming_queries,
    window_queries,
)

__all__ = ["ORACLES", "QUERIES", "Fixture", "oracle_text"]
