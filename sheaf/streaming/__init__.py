"""Structured Streaming over captures: an addition beside the batch operators."""
