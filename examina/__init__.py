"""Supervisory evidence analytics as set-oriented Spark jobs."""
