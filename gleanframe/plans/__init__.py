"""Plans of gleanframe."""
