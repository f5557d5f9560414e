"""Spark-first engine for corpus search and hygiene."""
