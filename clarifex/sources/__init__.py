"""Sources and sinks."""

from clarifex.sources.readers import DataLoader, read
from clarifex.sources.sinks import write

__all__ = ["DataLoader", "read", "write"]
