"""Temporal property graphs with time series, as Spark DataFrame jobs."""

from .model import TemporalGraph

__all__ = ["TemporalGraph"]
