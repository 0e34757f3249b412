"""Spark-first analytics for building and infrastructure model data."""
