"""Typed failures raised by the jobs."""


class TidewattError(Exception):
    """Base class."""


class InputError(TidewattError):
    """Columns are missing or a series is too short."""


class ArtefactError(TidewattError):
    """A saved model, scaler or threshold is not where it should be."""


class WindowError(TidewattError):
    """No sequence or window can be cut from the rows given."""
