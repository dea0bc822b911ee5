"""Matching, tracking and judging observations as Spark DataFrame operators."""
