"""Spark operators for multi-source evidence tables."""
