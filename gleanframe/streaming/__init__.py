"""Streaming of gleanframe."""
