"""Sources and sinks."""

from gleanframe.sources.tables import table

__all__ = ["table"]
