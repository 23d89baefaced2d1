"""Imports every query module so that the registry is complete."""

from . import ml_queries, model_queries, profile_queries, time_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
