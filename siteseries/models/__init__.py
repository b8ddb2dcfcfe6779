"""Resampled model selection on Spark ML."""
