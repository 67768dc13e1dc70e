"""Trajectory and offline-Q analytics on Spark DataFrames."""
