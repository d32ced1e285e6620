"""What planning and execution refuse."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class QueryError(Exception):
    """A query that means nothing against its catalog."""


class SyntaxFault(QueryError):
    def __init__(self, pos: int, msg: str):
        super().__init__(f"syntax error at {pos}: {msg}")
        self.pos = pos


class NotSupported(QueryError):
    """A feature that is left out on purpose."""


class FullScanRefused(QueryError):
    """A scan that neither keys nor a limit bound."""


class OrderRefused(QueryError):
    """An order that no access path provides."""


class DuplicateKey(QueryError):
    """A key that a unique path has already."""


class Conflict(QueryError):
    """A snapshot that moved while a change was being prepared."""


class RunError(QueryError):
    """A query that failed while its rows were computed: an overflow, a division by zero, a lost file."""


@contextmanager
def running() -> Iterator[None]:
    """Turns Spark's errors into RunError."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        lines = str(getattr(e, "java_exception", None) or e).strip().splitlines()
        raise RunError(lines[0] if lines else type(e).__name__) from e
