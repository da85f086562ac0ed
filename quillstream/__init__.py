"""Timed-text analytics and corpus preparation as Spark DataFrame jobs."""
