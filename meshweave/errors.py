"""Errors raised by the library."""


class MeshError(Exception):
    """Base of all."""


class NotImplementedHere(MeshError, NotImplementedError):
    """The format or combination isn't supported."""


class InvalidState(MeshError, RuntimeError):
    """The call doesn't fit what was done before."""


class ValueProblem(MeshError, ValueError):
    """A value, name or combination of options is wrong."""


class TypeProblem(MeshError, TypeError):
    """A field has another type than is needed."""


class SizeProblem(MeshError, ValueError):
    """Sizes or layouts don't fit."""


class FileProblem(MeshError, OSError):
    """A file can't be read or isn't what it should be."""
