"""Streaming of the corpus engine."""
