"""Structured Streaming forms of the aggregates that combine piece by piece."""

from manyworlds.streaming.aggregates import windowed_confidence

__all__ = ["windowed_confidence"]
