"""Operators over state tables; importing them registers their decisions."""

from tidewright.operators import lifecycle, objects, scheduling, traces  # noqa: F401
