"""Structured Streaming: watch mode."""
