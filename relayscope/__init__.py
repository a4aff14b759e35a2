"""Relayscope: delivery analytics, retrieval and memory operators as Spark jobs."""
