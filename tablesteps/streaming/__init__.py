"""Structured Streaming support for file-drop sources (S3)."""
