"""Registers the queries of all modules."""

from tidewell.plans import queries_basic, queries_forecast, queries_series  # noqa: F401
