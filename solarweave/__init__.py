"""Rooftop layout analytics and corpus preparation as Spark jobs."""
