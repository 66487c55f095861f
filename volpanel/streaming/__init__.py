"""Structured Streaming entry points for daily files and quote streams."""
