"""Label-quality flags and the document-type rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import DEFAULT_RULES, DOC_TYPES, RuleSet
from .jsonx import as_text, is_string
from .text import contains_any, normalize_text


def date_is_suspicious(value: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Cleaning-time flag on an ``effective_date`` variant; only strings can be suspicious."""
    return is_string(value) & contains_any(F.lower(as_text(value)), rules.date_words)


def truth_flags(date_text: Column, parties_text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Names of the truth fields that look mislabelled, in field order date, parties."""
    return F.array_compact(
        F.array(
            F.when(contains_any(normalize_text(date_text), rules.date_words), F.lit("effective_date")),
            F.when(contains_any(F.lower(parties_text), rules.party_words), F.lit("parties")),
        )
    )


def truth_is_flagged(normal_date: Column, lower_parties: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Whether :func:`truth_flags` names a field, from the normalised date and the parties in lower case."""
    return contains_any(normal_date, rules.date_words) | contains_any(lower_parties, rules.party_words)


def document_type(text: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return document_type_of_lower(F.lower(text), rules)


def document_type_of_lower(lowered: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """:func:`document_type` of a text in lower case, which is searched for each marker."""
    templated, filing = DOC_TYPES
    return F.when(contains_any(lowered, rules.filing_markers), F.lit(filing)).otherwise(F.lit(templated))
