"""Structured Streaming over decision and event logs (an extension of the batch operators)."""
