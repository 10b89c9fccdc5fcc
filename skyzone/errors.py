"""Errors that callers can tell apart."""


class MatchError(Exception):
    """A request that can't be answered as asked."""


class ConfigError(MatchError):
    pass


class InputError(MatchError):
    def __init__(self, message: str, source: str | None = None):
        super().__init__(message)
        self.source = source


class ServiceError(MatchError):
    """A remote table service failed."""
