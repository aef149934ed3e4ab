"""A frozen blueprint over a stream."""

from clarifex.streaming.apply import clean_stream, freeze

__all__ = ["clean_stream", "freeze"]
