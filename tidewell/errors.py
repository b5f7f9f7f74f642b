"""Exceptions of the single-row interfaces; bulk operators return tables of errors instead."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class NotFound(EngineError):
    """A row addressed by key does not exist."""


class DuplicateEntry(EngineError):
    """A unique key is taken."""


class ForeignKeyError(EngineError):
    """A referenced row does not exist."""


class QuerySyntaxError(EngineError):
    """A search query can't be parsed."""


class ConfigError(EngineError):
    """A configuration can't be read or is not valid."""


class FetchError(EngineError):
    """A response can't be used."""


class RateLimited(FetchError):
    def __init__(self, retry_after: int) -> None:
        super().__init__(f"rate limited, retry after {retry_after} s")
        self.retry_after = retry_after


class EmbeddingError(EngineError):
    """An embedding reply is malformed or has the wrong width."""


class UrlRejected(EngineError):
    """A URL is not public http or https."""
