"""Landmark-based prediction on event data, as Spark DataFrame jobs."""
