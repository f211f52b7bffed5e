"""Exceptions of the library."""


class EngineError(Exception):
    """Base of all."""


class ModelNotFound(EngineError):
    pass


class InvalidArgument(EngineError, ValueError):
    pass


class DecodeError(EngineError):
    pass


class InferenceError(EngineError):
    pass


class Unsupported(EngineError):
    """The engine has no such operation, as a gesture model that is given an image."""
