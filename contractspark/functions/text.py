"""Text functions on columns: stripping, normalising, splitting, containment."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip()/str.split() treats as white space.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for regular expressions; single Latin characters are listed one by one because the
# JVM keeps those in one bit set, while each range or category costs a call per character.
SPACE_CLASS = r" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\p{Z}"
SPACE_RUN = f"[{SPACE_CLASS}]+"
# A run that is not one blank already, so that most texts are left as they are. Its class holds the same
# characters, written without a category: such a pattern reads a text by its units, not by code points.
_FAR_SPACES = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = rf"[[ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{{85}}\x{{a0}}][\x{{1680}}-\x{{3000}}&&[{_FAR_SPACES}]]]"
UNEVEN_SPACE_RUN = f"{_SPACE}(?:{_SPACE}+|(?<! ))"
NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]"
# The same set; the frequent characters are a class of their own, looked at before the categories.
NOT_WORD_OR_SPACE_RUN = rf"[^[abcdefghijklmnopqrstuvwxyz0123456789_ ][\p{{L}}\p{{N}}{SPACE_CLASS}]]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row however often the body uses it.

    Without it a value used in several branches is expanded into each of them, and nested uses
    multiply: generated methods outgrow the size the JVM compiles.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def apart(value: Column) -> Column:
    """``value`` as it is, in a projection that is compiled on its own and in parts.

    Whole-stage code puts all expressions of a projection into one method, and the JVM leaves methods beyond 8,000
    bytes uncompiled. A lambda has no generated code, which keeps its projection out of that.
    """
    return let(value, lambda v: v)


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def strip_stored(text: Column) -> Column:
    """:func:`strip` for a value at hand in a column, which it reads several times.

    Trimming a set of characters costs a pass over the text with a search per end; nearly all texts begin and
    end with a printable ASCII character and are told by that, at usual ends without counting characters.
    """
    last = F.substring(text, -1, 1)
    usual = F.endswith(text, F.lit("}")) | F.endswith(text, F.lit(".")) | F.endswith(text, F.lit("`"))
    return F.when((text >= "!") & (text < "\x7f") & (usual | (last >= "!") & (last < "\x7f")), text).otherwise(strip(text))


def strip_end(text: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(text, F.lit(chars))


def collapse_spaces(text: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.trim(F.regexp_replace(text, UNEVEN_SPACE_RUN, " "))


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text.

    Replacing keeps its compiled expression from row to row, splitting does not; a split at one blank needs none.
    """
    return F.filter(F.split(F.regexp_replace(text, SPACE_RUN, " "), " "), lambda w: w != "")


def normal_words(normal: Column) -> Column:
    """Words of a text that :func:`normalize_text` returned."""
    return F.array_remove(F.split(normal, " "), "")


def normalize_text(text: Column) -> Column:
    """Lower case, punctuation deleted, white space collapsed; NULL becomes the empty string."""
    return normalize_lower(F.lower(text))


def normalize_lower(lowered: Column) -> Column:
    """:func:`normalize_text` of a text in lower case."""
    bare = F.regexp_replace(lowered, NOT_WORD_OR_SPACE_RUN, "")
    return F.coalesce(collapse_spaces(bare), F.lit(""))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return F.coalesce(hit, F.lit(False))


def truncate(text: Column, limit: int, mark: str = "") -> Column:
    """First ``limit`` characters; ``mark`` is appended only when something was cut."""
    if not mark:
        return F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def last_position(text: Column, char: str) -> Column:
    """1-based position of the last occurrence of a single character, 0 when absent."""
    back = F.locate(char, F.reverse(text))
    return F.when(back > 0, F.length(text) - back + 1).otherwise(F.lit(0))


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def or_default(text: Column, default: str) -> Column:
    """NULL and the empty string become ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
