"""Tidemark: ordered-sequence, embedding and text analytics on Spark."""
