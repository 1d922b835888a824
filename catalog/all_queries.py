"""Loads every query module and hands out the two registries."""

from catalog import (  # noqa: F401
    asset_queries,
    export_queries,
    feed_queries,
    ledger_queries,
    sink_queries,
    stream_queries,
    tensor_queries,
    text_queries,
)
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
