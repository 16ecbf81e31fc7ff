"""Row-level tests that the checks count, as SQL text over a column reference."""

from __future__ import annotations

from plumbline.functions.columns import number, text

# The accepted e-mail shape and the phrases that mark a subject as spam.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SPAM_KEYWORDS = ("!!!", "URGENT", "BUY NOW", "ACT FAST", "LIMITED TIME")


def bad_email(c: str) -> str:
    """True for anything but a well-formed address; a missing one is bad too."""
    return f"NOT coalesce({c} RLIKE {text(EMAIL_PATTERN)}, false)"


def looks_like_spam(c: str) -> str:
    """True when any keyword occurs in any letter case; NULL is not spam."""
    return f"{c} RLIKE {text('(?iu)' + '|'.join(SPAM_KEYWORDS))}"


def outside(c: str, low: float, high: float) -> str:
    """True strictly outside [low, high]; NULL is not outside."""
    return f"({c} < {number(low)} OR {c} > {number(high)})"


def shorter_than(c: str, characters: int) -> str:
    """True below this many characters; NULL for a missing or a longer text.

    Counting characters walks through the whole text. Its length in bytes is known, and
    a character takes one to four of them, so most texts need no counting. The branches
    of CASE keep the count from being pulled out and done for every row.
    """
    return (
        f"CASE WHEN octet_length({c}) < {4 * characters} "
        f"THEN length({c}) < {characters} END"
    )


def longer_than(c: str, characters: int) -> str:
    """True above this many characters; NULL for a missing or a shorter text."""
    return (
        f"CASE WHEN octet_length({c}) > {4 * characters} THEN true "
        f"WHEN octet_length({c}) > {characters} THEN length({c}) > {characters} END"
    )
