"""Structured Streaming entry point for request feeds."""
