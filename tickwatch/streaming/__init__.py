"""Structured Streaming jobs; they share their transforms with the batch operators."""
