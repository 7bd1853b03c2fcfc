"""Errors that a request's author can mend."""


class RequestError(ValueError):
    """The request can't be answered as it stands."""
