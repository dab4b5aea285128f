"""Compact image placeholders and the analytics around them, on Spark."""
