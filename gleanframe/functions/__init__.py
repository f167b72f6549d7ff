"""Functions of gleanframe."""
