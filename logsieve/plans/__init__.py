"""Whole plans, from a source to an answer."""

from .engine import Engine, canonical_logs, features_of_file

__all__ = ["Engine", "canonical_logs", "features_of_file"]
