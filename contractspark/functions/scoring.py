"""Scores of a predicted text against the truth, each between 0 and 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import normalize_date
from .text import NOT_WORD_OR_SPACE_RUN, collapse_spaces, let, normal_words, normalize_text

# The word "and" in any case; its first letter is looked at before the boundaries, which cost more.
AND = r"(?U)[aA](?<=\b[aA])[nN][dD]\b"
NOT_NAME_OR_COMMA_RUN = NOT_WORD_OR_SPACE_RUN.replace("[^[", "[^[,", 1)


def token_set(text: Column) -> Column:
    return normal_token_set(normalize_text(text))


def normal_token_set(normal: Column) -> Column:
    return F.array_distinct(normal_words(normal))


def split_parties(text: Column) -> Column:
    """Distinct normalised party names of a text, split at ``,`` ``;`` and the word "and"."""
    return party_set(party_key(text))


def party_key(text: Column) -> Column:
    """The normalised party names of a text, joined by commas; it may hold empty names.

    All separators become commas first, so the text is normalised at once, with its commas kept.
    """
    commas = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), AND, ","), F.lit(";"), F.lit(","))
    bare = collapse_spaces(F.regexp_replace(F.lower(commas), NOT_NAME_OR_COMMA_RUN, ""))
    return F.replace(F.replace(bare, F.lit(" ,"), F.lit(",")), F.lit(", "), F.lit(","))


def party_set(key: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(key, ","), ""))


def sets_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two sets given as arrays without duplicates; two empty sets agree."""
    n_pred, n_truth = F.size(predicted), F.size(truth)
    return let(F.size(F.array_intersect(predicted, truth)), lambda common: _f1(n_pred, n_truth, common))


def with_set_scores(pairs: DataFrame, scores: dict[str, tuple[str, str, Callable[[Column], Column]]]) -> DataFrame:
    """Adds columns ``name``: :func:`sets_f1` of two text columns that a function splits into sets.

    Equal texts have equal sets and are not split. Sets and what they share are projections of their own.
    """
    sets, counts, named = {}, {}, {}
    for name, (predicted, truth, splitter) in scores.items():
        p, t = F.col(predicted), F.col(truth)
        sets |= {f"_p_{name}": F.when(p != t, splitter(p)), f"_t_{name}": F.when(p != t, splitter(t))}
        p, t = F.col(f"_p_{name}"), F.col(f"_t_{name}")
        counts |= {f"_{kind}_{name}": F.size(of) for kind, of in (("np", p), ("nt", t), ("nc", F.array_intersect(p, t)))}
        same = F.col(predicted) == F.col(truth)
        named[name] = F.when(same, F.lit(1.0)).otherwise(_f1(*[F.col(f"_{kind}_{name}") for kind in ("np", "nt", "nc")]))
    return pairs.withColumns(sets).withColumns(counts).withColumns(named).drop(*sets, *counts)


def _f1(n_pred: Column, n_truth: Column, common: Column) -> Column:
    precision, recall = common / n_pred, common / n_truth
    return (
        F.when((n_pred == 0) & (n_truth == 0), F.lit(1.0))
        .when((n_pred == 0) | (n_truth == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * (precision * recall) / (precision + recall))
    )


def set_f1(predicted: Column, truth: Column, splitter: Callable[[Column], Column]) -> Column:
    split = let(splitter(predicted), lambda p: let(splitter(truth), lambda t: sets_f1(p, t)))
    return F.when(predicted == truth, F.lit(1.0)).otherwise(split)  # equal texts have equal sets


def token_f1(predicted: Column, truth: Column) -> Column:
    return set_f1(predicted, truth, token_set)


def party_f1(predicted: Column, truth: Column) -> Column:
    return set_f1(predicted, truth, split_parties)


def date_match(predicted: Column, truth: Column) -> Column:
    agree = F.when(normalize_date(predicted) == normalize_date(truth), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(predicted == truth, F.lit(1.0)).otherwise(agree)


def score_field(field: str, predicted: Column, truth: Column) -> Column:
    if field == "parties":
        return party_f1(predicted, truth)
    if field == "effective_date":
        return date_match(predicted, truth)
    return token_f1(predicted, truth)
