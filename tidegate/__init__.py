"""Data contracts and run analytics as Spark table and stream operators."""

from tidegate.results import GateError, GateResult

__all__ = ["GateError", "GateResult"]
