"""Spark-first engine for detecting, resolving, masking and verifying sensitive text."""
