"""Operators of gleanframe."""
