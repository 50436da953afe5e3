"""Imports every module that registers queries."""

from premia.plans.registry import REGISTRY
from premia.plans import factors, models, monitoring, preparation, profiling, rating, validation  # noqa: F401

__all__ = ["REGISTRY"]
