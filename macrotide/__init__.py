"""Macro time-series analytics as lazy PySpark DataFrame jobs."""
