"""Pixel, clip and training-data analytics as Spark DataFrame jobs."""
