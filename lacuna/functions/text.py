"""Text keys shared by all operators: when two names are the same, and when a field says nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words which, alone in a field, say that nothing is given
# (compared without case, blanks and punctuation).
MISSING_WORDS = [
    "blank",
    "empty",
    "missing",
    "na",
    "nan",
    "nil",
    "nodata",
    "none",
    "notapplicable",
    "notavailable",
    "notgiven",
    "notreported",
    "notspecified",
    "notstated",
    "novalue",
    "null",
    "tba",
    "tbd",
    "undefined",
    "unknown",
    "unreported",
    "unspecified",
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def same_key(c: Column | str) -> Column:
    """Equal for texts that agree once case and all but ASCII letters and digits are disregarded; null stays null."""
    return F.lower(F.regexp_replace(_col(c), "[^A-Za-z0-9]", ""))


def is_missing(c: Column | str) -> Column:
    """True for null, blank text, text of marks only, and the words of ``MISSING_WORDS``."""
    bare = F.lower(F.regexp_replace(_col(c), r"[\s\p{P}\p{S}\p{Z}\p{C}]+", ""))
    return _col(c).isNull() | (bare == "") | bare.isin(MISSING_WORDS)


def given(c: Column | str) -> Column:
    """The text, or null where it is missing."""
    return F.when(~is_missing(c), _col(c))


def given_key(c: Column | str) -> Column:
    """``same_key`` of a field that says something, else null."""
    key = same_key(c)
    return F.when(~is_missing(c) & (key != ""), key)
