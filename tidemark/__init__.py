"""Tidemark: time-series lakehouse analytics as Spark DataFrame programs."""
