"""Data-quality, cohort, drift and training-data operators as Spark plans."""
