"""Text expressions; all stay in the JVM.  Patterns are of both."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str methods see it.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# What ends a sentence, what must follow, both as one pattern, and the form of a citation.
SENTENCE_STOP = ".!?"
SENTENCE_GAP = " \t\n"
SENTENCE_BREAK = r"(?<=[.!?])[ \t]*\n+|(?<=[.!?])[ \t]+"
CITATION = r"\[(\d{1,3})\]"
#: A lexical term of a lower-cased text.
TERM = re.compile("[a-z0-9]+")


def terms(text: Column) -> Column:
    """Lexical terms: runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM.pattern), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squash(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences in order; a sentence ends at . ! ? before white space."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), strip), lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-cased words between white space, without repetition."""
    return F.array_distinct(F.filter(F.split(F.lower(squash(F.coalesce(text, F.lit("")))), " "), lambda w: w != ""))


def approximate_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and other characters that are no white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]"))


def strip_citations(text: Column) -> Column:
    return squash(F.regexp_replace(text, CITATION, " "))


def citation_markers(text: Column) -> Column:
    """Distinct markers in the order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), 1), lambda x: x.cast("int")))


def overlaps(hay: Column, needle: Column, width: int = 50) -> Column:
    """Whether squashed text ``hay`` holds squashed ``needle``, or any window of ``width`` characters of it.

    Both are to be columns squashed beforehand: inside a lambda they would be squashed for every window.
    """
    windows = F.sequence(F.lit(1), F.greatest(F.length(needle) - (width - 1), F.lit(1)))
    # Every window holds one of the blocks of half its width side by side; so few that are none of them are cut out at all.
    half = max(1, width // 2)
    blocks = F.sequence(F.lit(1), F.greatest(F.length(needle) - (half - 1), F.lit(1)), F.lit(half))
    part = F.exists(blocks, lambda i: hay.contains(needle.substr(i, F.lit(half)))) & F.exists(windows, lambda i: hay.contains(needle.substr(i, F.lit(width))))
    return (F.length(hay) > 0) & (F.length(needle) > 0) & (hay.contains(needle) | ((F.length(needle) >= width) & part))


def title(metadata: Column, path: Column) -> Column:
    """The stated title if it is not blank, else the file's name."""
    stated = strip(F.element_at(metadata, "title"))
    return F.coalesce(F.nullif(stated, F.lit("")), F.element_at(F.split(path, "/"), -1))
