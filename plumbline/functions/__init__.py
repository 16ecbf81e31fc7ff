"""Column helpers and row-level predicates shared by the operators."""

from plumbline.functions.columns import (
    col,
    fixed,
    is_numeric,
    is_text,
    normalise,
    number,
    numeric_columns,
    quoted,
    ratio,
    text,
    text_columns,
)
from plumbline.functions.predicates import (
    EMAIL_PATTERN,
    SPAM_KEYWORDS,
    bad_email,
    longer_than,
    looks_like_spam,
    outside,
    shorter_than,
)

__all__ = [
    "EMAIL_PATTERN",
    "SPAM_KEYWORDS",
    "bad_email",
    "col",
    "fixed",
    "is_numeric",
    "is_text",
    "longer_than",
    "looks_like_spam",
    "normalise",
    "number",
    "numeric_columns",
    "outside",
    "quoted",
    "ratio",
    "shorter_than",
    "text",
    "text_columns",
]
