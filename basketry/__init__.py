"""Retail analytics data products as Spark jobs."""
