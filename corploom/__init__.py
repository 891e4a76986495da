"""Corpus-mixture analytics on Spark."""
