"""What the engine raises; all have one base."""


class ClarifexError(Exception):
    """Base of the engine's errors."""


class ValidationError(ClarifexError, ValueError):
    """A mode, an option or a blueprint that is not acceptable."""


class EngineError(ClarifexError, RuntimeError):
    """A blueprint could not be carried out."""


class UnknownToolError(EngineError, NotImplementedError):
    """A blueprint names tools that nobody registered."""


class DiskError(EngineError, OSError):
    """A sink could not be written."""


class MemoryLimitError(EngineError, MemoryError):
    """An input that is read whole is too large."""


class SourceError(ClarifexError):
    """Base of what is wrong with a source."""


class FormatError(SourceError, ValueError):
    """A format that cannot be read."""


class SecurityError(SourceError, PermissionError):
    """A path that does not lead to a readable, non-empty source."""


class SchemaError(ClarifexError, TypeError):
    """A schema that an operation does not take."""


class CollisionError(SchemaError):
    """Two columns would get one name."""


class ReconstructionError(ClarifexError, RuntimeError):
    """The original shape cannot be restored."""
