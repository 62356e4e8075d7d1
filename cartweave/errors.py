"""Errors that callers can tell apart."""


class EngineError(Exception):
    pass


class UnknownInputFormat(EngineError):
    pass


class UnknownOutputFormat(EngineError):
    pass


class FilterSyntaxError(EngineError, ValueError):
    pass


class BadElement(EngineError, ValueError):
    pass
