"""Structured Streaming over what the engine writes."""
