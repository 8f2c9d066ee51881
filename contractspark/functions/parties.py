"""Cleaning of party entries: one rule ladder per entry, then the list or string that holds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import DEFAULT_RULES, RuleSet
from .jsonx import as_text, elements, is_list, is_string
from .text import strip, strip_end, words

KEPT, TRUNCATED, DROPPED = "", "truncated", "dropped"


def _verdict(cleaned: Column, reason: str) -> Column:
    return F.struct(cleaned.alias("cleaned"), F.lit(reason).alias("reason"))


def clean_entries(entries: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """array<struct(cleaned, reason)> for an array of entries; NULL entries stand for non-strings.

    Three passes over the array, so that each regular expression runs once per entry.
    """
    bare = F.transform(entries, lambda e: strip(e))
    names = F.transform(bare, lambda e: F.when(e != "", strip(F.regexp_replace(e, rules.label_regex, ""))))
    located = F.transform(
        names,
        lambda name: F.struct(
            name.alias("name"),
            F.regexp_instr(name, F.lit(rules.clause_regex)).alias("clause_at"),
            F.regexp_instr(name, F.lit(rules.boilerplate_regex)).alias("wrapper_at"),
        ),
    )

    def verdict(entry: Column) -> Column:
        name, clause_at, wrapper_at = entry["name"], entry["clause_at"], entry["wrapper_at"]
        lead = strip(strip_end(strip(F.substring(name, F.lit(1), wrapper_at - 1)), ","))
        dropped = _verdict(F.lit(""), DROPPED)
        return (
            F.when(name.isNull(), dropped)
            .when((clause_at > 0) & (clause_at <= rules.clause_lead_chars), dropped)
            .when((wrapper_at > 0) & (F.length(lead) >= rules.min_name_chars), _verdict(lead, TRUNCATED))
            .when(wrapper_at > 0, dropped)
            .when((clause_at > 0) & (F.size(words(name)) > rules.max_name_words), dropped)
            .otherwise(_verdict(name, KEPT))
        )

    return F.transform(located, verdict)


def party_entries(parties: Column) -> Column:
    """Entries of a ``parties`` variant as array<string>; NULL when it is neither list nor string.

    A non-string list entry becomes NULL, which the cleaner drops.
    """
    listed = F.transform(elements(parties), lambda e: F.when(is_string(e), as_text(e)))
    cut = F.filter(F.transform(F.split(as_text(parties), "[,;]"), lambda p: strip(p)), lambda p: p != "")
    return F.when(is_list(parties), listed).when(is_string(parties), cut)


def _original_entries(parties: Column) -> Column:
    listed = F.transform(elements(parties), as_text)
    return F.when(is_list(parties), listed).otherwise(party_entries(parties))


def clean_parties(parties: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """array<struct(original, cleaned, reason)>, one item per entry in order, NULL for other types."""
    return F.zip_with(
        _original_entries(parties),
        clean_entries(party_entries(parties), rules),
        lambda original, v: F.struct(
            original.alias("original"), v["cleaned"].alias("cleaned"), v["reason"].alias("reason")
        ),
    )


def dropped_entries(items: Column) -> Column:
    return F.transform(F.filter(items, lambda i: i["reason"] == DROPPED), lambda i: i["original"])


def truncated_pairs(items: Column) -> Column:
    return F.transform(
        F.filter(items, lambda i: i["reason"] == TRUNCATED),
        lambda i: F.struct(i["original"].alias("original"), i["cleaned"].alias("cleaned")),
    )


def kept_entries(items: Column) -> Column:
    return F.transform(F.filter(items, lambda i: i["reason"] != DROPPED), lambda i: i["cleaned"])
