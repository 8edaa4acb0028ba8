"""Query catalogue. Importing the package registers every query."""

from . import (  # noqa: F401
    chain_queries,
    ev_queries,
    io_queries,
    list_queries,
    metric_queries,
    model_queries,
    route_queries,
    scalar_queries,
    stream_queries,
    tick_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
