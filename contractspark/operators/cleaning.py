"""Label cleaning with a reviewable change report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import date_is_suspicious
from ..functions.jsonx import is_empty_object, is_list, strict_label
from ..functions.messages import first_of_role, role_index
from ..functions.parties import clean_parties, dropped_entries, kept_entries, truncated_pairs
from ..rules import DEFAULT_RULES, RuleSet
from .indexing import dense_index

REPORT_COLUMNS = ("parties_dropped", "parties_truncated", "effective_date_flagged", "modified")


def with_label(examples: DataFrame) -> DataFrame:
    """Adds ``assistant_text`` (first assistant message) and ``label``, its parsed JSON or NULL."""
    return examples.withColumn("assistant_text", first_of_role(F.col("messages"), "assistant")).withColumn(
        "label", strict_label(F.col("assistant_text"))
    )


def has_content(text: str = "assistant_text", label: str = "label"):
    """True when the label parsed and holds at least one key."""
    return F.col(label).isNotNull() & ~is_empty_object(F.col(text))


def exclude_empty(labelled: DataFrame) -> DataFrame:
    """Only examples whose label is a non-empty object. Input comes from :func:`with_label`.

    An explode of one or no label instead of a filter: a filter would be pushed below the projection
    that parses the label, and every row would be parsed twice.
    """
    return labelled.withColumn("label", F.explode(F.when(has_content(), F.array("label"))))


def clean_examples(examples: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Examples with content, their party lists cleaned, plus the report columns.

    The label is written back only if an entry was dropped or truncated; suspicious dates are flagged,
    never edited. Unknown label keys survive. Map stages only, so it also runs on streams.
    """
    parties = F.col("label")["parties"]
    kept = kept_entries(F.col("_items"))
    new_parties = F.when(is_list(parties), F.to_variant_object(kept)).otherwise(
        F.array_join(kept, ", ").cast("variant")
    )
    open_label = F.from_json(F.col("assistant_text"), "map<string,variant>")
    new_text = F.to_json(
        F.transform_values(open_label, lambda k, v: F.when(k == "parties", new_parties).otherwise(v))
    )
    rewritten = F.transform(
        F.col("messages"),
        lambda m, i: F.when(i == F.col("_at"), F.struct(m["role"].alias("role"), new_text.alias("content")))
        .otherwise(m),
    )
    no_items = F.array().cast("array<struct<original:string,cleaned:string,reason:string>>")
    return (
        exclude_empty(with_label(examples))
        .withColumn("_items", F.coalesce(clean_parties(parties, rules), no_items))
        .withColumn("_at", role_index(F.col("messages"), "assistant"))
        .withColumn("parties_dropped", dropped_entries(F.col("_items")))
        .withColumn("parties_truncated", truncated_pairs(F.col("_items")))
        .withColumn("effective_date_flagged", date_is_suspicious(F.col("label")["effective_date"], rules))
        .withColumn("modified", F.size("parties_dropped") + F.size("parties_truncated") > 0)
        .withColumn("messages", F.when(F.col("modified"), rewritten).otherwise(F.col("messages")))
        .drop("_items", "_at", "label", "assistant_text")
    )


def cleaning_report(cleaned: DataFrame, id_column: str = "example_id", folder: str | None = None) -> DataFrame:
    """Rows with a change or a flag, with their 0-based index among all surviving examples.

    The input is evaluated once; ``folder`` is where :func:`dense_index` keeps its tables.
    """
    slim = dense_index(cleaned.select(id_column, *REPORT_COLUMNS), id_column, "example_index", folder)
    return slim.where(F.col("modified") | F.col("effective_date_flagged"))


def cleaning_summary(examples: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row of counts. Both inputs are reduced to partial sums where they lie."""
    totals = cleaned.agg(
        F.count("*").alias("survivors"),
        F.count_if("modified").alias("examples_modified"),
        F.coalesce(F.sum(F.size("parties_dropped").cast("bigint")), F.lit(0)).alias("entries_dropped"),
        F.coalesce(F.sum(F.size("parties_truncated").cast("bigint")), F.lit(0)).alias("entries_truncated"),
        F.count_if("effective_date_flagged").alias("dates_flagged"),
    )
    everything = examples.agg(F.count("*").alias("n")).scalar()
    return totals.withColumn("empties_excluded", everything - F.col("survivors"))
