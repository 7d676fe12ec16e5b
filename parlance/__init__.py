"""Parlance: building, checking and scoring two-speaker conversation datasets on Spark."""
