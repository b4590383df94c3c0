"""Imports every query module so the registry is complete."""

from murmur.plans import (q_geo, q_models, q_profiles, q_reliability, q_sources, q_spatial,  # noqa: F401
                          q_streaming, q_summary, q_temporal, q_text, q_users, q_misc)
from murmur.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
