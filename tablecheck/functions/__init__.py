"""Column expressions shared by the operators."""

from tablecheck.functions.columns import bounded_key, quoted, row_key
from tablecheck.functions.text import EMAIL_PATTERN, PHONE_PATTERN, full_match
from tablecheck.functions.types import family

__all__ = [
    "EMAIL_PATTERN",
    "PHONE_PATTERN",
    "bounded_key",
    "family",
    "full_match",
    "quoted",
    "row_key",
]
