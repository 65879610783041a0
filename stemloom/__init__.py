"""Corpus comparison and time-series analytics, expressed as lazy Spark plans."""
