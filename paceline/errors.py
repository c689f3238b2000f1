"""Error texts for result rows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError


def error_text(error: Exception) -> str:
    """The first line of a message, with the root cause when Spark wrapped it."""

    def first_line(text) -> str:
        lines = str(text or "").strip().splitlines()
        return lines[0] if lines else ""

    if not isinstance(error, Py4JJavaError):
        return first_line(error) or type(error).__name__
    top = cause = error.java_exception
    while cause.getCause() is not None:
        cause = cause.getCause()
    message = first_line(top.getMessage()) or top.toString()
    root = first_line(cause.getMessage())
    return f"{message} ({root})" if root and root not in message else message
