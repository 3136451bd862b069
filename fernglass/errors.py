"""Failure kinds that callers tell apart."""


class EngineError(Exception):
    kind = "internal"


class InvalidRequest(EngineError):
    kind = "invalid_request"


class NotFound(EngineError):
    kind = "not_found"


class StartupError(EngineError):
    kind = "startup"


class UsageError(EngineError):
    kind = "usage"


#: HTTP status of each kind.
STATUS = {"usage": 400, "invalid_request": 400, "not_found": 404, "startup": 503, "internal": 500}
