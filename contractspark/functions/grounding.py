"""Is an extracted value supported by its source text?"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import CANDIDATE_NULLS, EVALUATION_NULLS, GROUNDED_SHARE
from .text import let, normal_words, strip, strip_stored, words

NORMAL_NULLS = tuple(re.sub(r"[^\w\s]", "", null) for null in EVALUATION_NULLS)


def _share_found(value_words: Column, source: Column) -> Column:
    """Share of words that occur anywhere in the source; NULL without words."""
    return let(
        value_words,
        lambda ws: F.size(F.filter(ws, lambda w: F.contains(source, w))) / F.nullif(F.size(ws), F.lit(0)),
    )


def comparable(value: Column) -> Column:
    """A value as the candidate rule compares it: lower case, stripped; a missing one is null-like."""
    return F.coalesce(strip(F.lower(value)), F.lit("none"))


def found_in(value: Column, lower_source: Column) -> Column:
    """Candidate rule for a :func:`comparable` value. Words are split only if the value as a whole is not there."""
    return F.when(value.isin(*CANDIDATE_NULLS) | F.contains(lower_source, value), F.lit(True)).otherwise(
        F.coalesce(_share_found(words(value), lower_source) >= GROUNDED_SHARE, F.lit(True))
    )


def is_grounded(value: Column, lower_source: Column) -> Column:
    """Candidate rule, on lower-cased raw text; null-like and blank values count as grounded."""
    return let(comparable(value), lambda v: found_in(v, lower_source))


def is_hallucinated(value: Column, normal_value: Column, normal_source: Column) -> Column:
    """Evaluation rule: the value, the same normalised, and the normalised source text."""
    return is_unsupported(value.isNotNull() & is_populated(value), normal_value, normal_source)


def is_unsupported(claimed: Column, normal_value: Column, normal_source: Column) -> Column:
    """:func:`is_hallucinated` for a value known to be there and populated (``claimed``) or not."""
    return F.when(~claimed | F.contains(normal_source, normal_value), F.lit(False)).otherwise(
        F.coalesce(_share_found(normal_words(normal_value), normal_source) < GROUNDED_SHARE, F.lit(False))
    )


def is_populated(value: Column) -> Column:
    return ~strip(F.lower(value)).isin(*EVALUATION_NULLS)


def lower_is_populated(lowered: Column) -> Column:
    """:func:`is_populated` of a text in lower case at hand in a column."""
    return ~strip_stored(lowered).isin(*EVALUATION_NULLS)


def normal_is_populated(value: Column, normal_value: Column) -> Column:
    """:func:`is_populated` where the normalised value is at hand: only few of those can be null-like."""
    return ~(normal_value.isin(*NORMAL_NULLS) & strip(F.lower(value)).isin(*EVALUATION_NULLS))
