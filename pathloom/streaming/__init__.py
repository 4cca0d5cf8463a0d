"""Expanding, interval and sliding-window features: for one path, in batch, and in Structured Streaming."""
