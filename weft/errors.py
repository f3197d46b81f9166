"""Errors with stable codes, and the translation of Spark's run-time errors into them."""

from __future__ import annotations

import re

CODES = ("Syntax", "Semantic", "InvalidArgument", "ConstraintViolation", "Conflict", "ResourceExhausted", "NotFound", "AlreadyExists", "Unavailable", "Unauthenticated", "PermissionDenied", "DeadlineExceeded", "Internal")
RETRYABLE = frozenset({"Conflict", "Unavailable", "ResourceExhausted"})
#: Marks an error raised inside a Spark expression: code and message follow.
RAISED = "weft!"


class GraphError(Exception):
    def __init__(self, code: str, message: str, line: int = 0, col: int = 0):
        self.code, self.message, self.line, self.col = code, message, line, col
        super().__init__(f"{code}: {message}" + (f" at {line}:{col}" if line else ""))

    @property
    def retryable(self) -> bool:
        return self.code in RETRYABLE


_KNOWN = {
    "ARITHMETIC_OVERFLOW": "the number is out of range",
    "DIVIDE_BY_ZERO": "division by zero",
    "REMAINDER_BY_ZERO": "division by zero",
    "CAST_INVALID_INPUT": "the text can't be converted",
    "CAST_OVERFLOW": "the number is out of range",
    "CANNOT_PARSE_TIMESTAMP": "the text isn't a date and time",
    "DATETIME_OVERFLOW": "the date is out of range",
    "INTERVAL_ARITHMETIC_OVERFLOW": "the duration is out of range",
    "BINARY_ARITHMETIC_OVERFLOW": "the number is out of range",
}


def translated(error: Exception) -> Exception:
    """The GraphError that a failed Spark action stands for, or the error itself."""
    text = str(error)
    if m := re.search(rf"{RAISED}(\w+): ([^\n]*?){RAISED}", text):
        return GraphError(m[1], m[2])
    for name, message in _KNOWN.items():
        if f"[{name}" in text:
            return GraphError("InvalidArgument", message)
    return error
