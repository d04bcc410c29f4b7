"""Registered queries over the benchmark tables, each with its DuckDB counterpart where SQL can say it."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import audit, designs, frontier, learning, models, payloads, rare, sequential, store, streams, traces  # noqa: F401
