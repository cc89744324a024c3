"""Text rules shared by cleaning and text mining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's ``str.isspace`` sees it, written as one
# explicit character class so that Spark (Java regex) and the DuckDB oracle
# (RE2) agree character for character.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
ZERO_WIDTH_CLASS = r"[\x{200B}-\x{200F}\x{FEFF}]"
# The same set for Java regex, written with the Unicode White_Space class:
# three times faster than the explicit list (tests check that both agree
# on every BMP code point).
JAVA_WS_CLASS = r"(?U)[\s\x{1C}-\x{1F}]"
JAVA_NON_WS_CLASS = r"(?U)[^\s\x{1C}-\x{1F}]"


NON_WS_CLASS = "[^" + WS_CLASS[1:]    # RE2 / SQL form


def ws_trim(c: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips only spaces)."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def has_text(c: Column) -> Column:
    """True when the string holds any non-white-space character (one scan,
    no allocation; equals ``ws_trim(c) != ''``)."""
    return F.coalesce(c.rlike(JAVA_NON_WS_CLASS), F.lit(False))


def clean_text(c: Column) -> Column:
    """null -> '', strip, collapse white-space runs to one space, then drop
    zero-width characters (after the strip, so an edge space can remain).

    Collapsing first leaves at most one plain space at each edge, which the
    cheap ``trim`` removes: two regex passes instead of three, which matters
    because a filter on the cleaned text is pushed below the projection and
    evaluates the chain a second time."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), JAVA_WS_CLASS + "+", " "))
    return F.regexp_replace(t, ZERO_WIDTH_CLASS, "")


def word_pattern(words: list[str]) -> str:
    """Whole-word alternation with a Unicode-aware boundary (same text in
    Spark and DuckDB; DuckDB's ``\\b`` is ASCII-only)."""
    alt = "|".join(words)
    return f"(^|[^\\p{{L}}\\p{{N}}_])({alt})([^\\p{{L}}\\p{{N}}_]|$)"
