"""Screening analytics on Spark: declarative operators over typed tables."""
