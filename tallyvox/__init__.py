"""Feedback analytics and retrieval evaluation as Spark DataFrame jobs."""
