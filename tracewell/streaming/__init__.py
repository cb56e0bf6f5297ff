"""Structured Streaming: documents as they arrive."""
