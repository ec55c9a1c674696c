"""Trajectory analytics and corpus processing as declarative Spark plans."""
