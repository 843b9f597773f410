"""Spark-first engine for curating time-stamped recordings and text corpora."""
