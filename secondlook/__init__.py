"""Audit text-classification predictions with Spark: prompts, cached reviews, checks and reports."""

__version__ = "0.1.0"
