"""Errors of the public API, with the status and diagnostic code that callers see."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors: an HTTP-like status and a five-digit diagnostic code."""

    status, code = 500, "10500"

    def __init__(self, message: str = "", details: str | None = None) -> None:
        super().__init__(message)
        self.message, self.details = message, details


class InvalidArgument(EngineError):
    status, code = 400, "00400"


class Unauthenticated(EngineError):
    status, code = 401, "00401"


class Unauthorized(EngineError):
    status, code = 403, "00403"


class NotFound(EngineError):
    status, code = 404, "00404"


class AlreadyExists(EngineError):
    status, code = 409, "00409"


class Unimplemented(EngineError):
    status, code = 501, "10501"


class CollectionNotFound(NotFound):
    pass


class QuorumLost(EngineError):
    """Fewer nodes visible than the quorum; nothing was written."""


class LockError(EngineError):
    pass


class LockAcquireTimeout(LockError):
    """The lock was not free before the deadline."""
