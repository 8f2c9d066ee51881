"""Metrics as a comparison table and as nested JSON. Inputs have a few rows per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import DOC_TYPES, FIELDS, METRIC_LABELS, REPORT_FIELDS_TITLE, REPORT_TITLES, REPORT_TYPES_LINE
from .evaluation import METRICS, OVERALL, RATES


def metrics_table(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """``position, metric`` and one value column per model, in report order."""
    long = metrics.unpivot(["model"], list(METRICS), "metric", "value")
    wide = long.groupBy("metric").pivot("model", list(models)).agg(F.max("value"))
    order = F.array(*[F.lit(m) for m in METRICS])
    return wide.withColumn("position", F.array_position(order, F.col("metric")).cast("int"))


def markdown_table(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """``position, line``: the table body as markdown lines, rates first, then field scores."""
    labels = dict(METRIC_LABELS) | {f"f1_{f}": f"`{f}`" for f in FIELDS}
    label = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col("metric")]
    cells = F.concat_ws(" | ", label, *[F.concat(F.col(m).cast("string"), F.lit("%")) for m in models])
    return metrics_table(metrics, models).select(
        "position", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")
    )


def evaluation_report(metrics_by_scope: DataFrame, models: Sequence[str]) -> DataFrame:
    """``position, line``: the whole printed report as lines, empty ones included.

    A table of rates and one of field scores for each scope, with title, number of examples (of the first
    model), header and separator, then the number of examples of each document type. A model or scope
    that the metrics do not hold shows ``?``.
    """
    values = F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("/", "scope", "model"), F.struct("n", *METRICS),
    )))

    def value(scope: str, model: str, name: str) -> Column:
        return F.coalesce(F.col("values")[f"{scope}/{model}"][name].cast("string"), F.lit("?"))

    def row(*cells) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    def table(scope: str, head: str, labels: Sequence[tuple[str, str]]) -> list[Column]:
        rule = f"|{'-' * (len(head) + 2)}|" + "|".join(["---"] * len(models)) + "|"
        shown = [row(F.lit(text), *[F.concat(value(scope, m, name), F.lit("%")) for m in models]) for name, text in labels]
        return [row(F.lit(head), *map(F.lit, models)), F.lit(rule), *shown]

    lines = []
    for scope, title in REPORT_TITLES:
        n = value(scope, models[0], "n")
        lines += [F.lit(""), F.concat(F.lit(f"### {title} (n="), n, F.lit(")")), *table(scope, "Metric", METRIC_LABELS)]
        lines += [F.lit(""), F.lit(f"#### {REPORT_FIELDS_TITLE}"), *table(scope, "Field", [(f"f1_{f}", f"`{f}`") for f in FIELDS])]
    types = [F.concat(F.lit(f"'{t}': "), value(t, models[0], "n")) for t in DOC_TYPES]
    lines += [F.lit(""), F.concat(F.lit(REPORT_TYPES_LINE + "{"), F.concat_ws(", ", *types), F.lit("}"))]
    return metrics_by_scope.agg(values.alias("values")).select(F.posexplode(F.array(*lines)).alias("position", "line"))


def metrics_json(metrics_by_scope: DataFrame) -> DataFrame:
    """One row: ``{"overall": {model: record}, "by_document_type": {type: {model: record}}}``."""
    record = F.struct(
        *RATES, F.struct(*[F.col(f"f1_{f}").alias(f) for f in FIELDS]).alias("field_f1"), "n"
    )
    by_model = metrics_by_scope.groupBy("scope").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", record.alias("record"))))).alias("models")
    )

    def of(scope: str):
        return F.max_by("models", F.when(F.col("scope") == scope, F.lit(1))).alias(scope)

    by_type = F.struct(*[of(t) for t in DOC_TYPES]).alias("by_document_type")
    return by_model.agg(F.to_json(F.struct(of(OVERALL), by_type)).alias("metrics_json"))
