"""Errors of this package."""


class MeridianError(ValueError):
    """Input that can't be searched, read or written."""
