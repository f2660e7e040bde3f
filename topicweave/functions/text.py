"""Text predicates and normalisation matching Python ``str`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace is Unicode-wide; Java's \s is ASCII. Non-blank means "has one
# character that is neither ASCII whitespace, a Unicode separator, nor a control
# separator Python treats as space".
_NON_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"

# Python's \W (Unicode) is anything outside letters, digits and underscore.
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"


def is_non_blank(text: Column) -> Column:
    """``text and not text.isspace()`` / ``text and text.strip()``."""
    return text.isNotNull() & text.rlike(_NON_SPACE)


def py_strip(text: Column) -> Column:
    """Python ``str.strip()`` for the ASCII whitespace that responses contain.

    Plain ``trim`` only removes spaces; responses end in newlines.
    """
    return F.regexp_replace(text, r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$", "")


def normalise_words(text: Column) -> Column:
    """lower-case, replace each run of non-word characters with one space."""
    return F.regexp_replace(F.lower(text), NON_WORD_RUN, " ")


def words(text: Column) -> Column:
    """``str.split()`` of an already normalised text: non-empty space-separated words."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
