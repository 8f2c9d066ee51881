"""Per-chunk outputs to one record per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import as_text, elements, first_object, is_list, is_string
from ..rules import NOT_SPECIFIED, SCALAR_FIELDS


def _facts(label: Column) -> Column:
    """array<struct(field, pos, value)> of one parsed chunk, without the "Not Specified" ones.

    A missing key gives no fact; a JSON null is a fact with a NULL value, because it counts as a value.
    """
    parties = label["parties"]
    listed = F.when(is_list(parties), F.transform(elements(parties), as_text)).when(
        is_string(parties), F.array(as_text(parties))
    )
    named = F.transform(
        F.coalesce(listed, F.array().cast("array<string>")),
        lambda v, i: F.struct(F.lit("parties").alias("field"), i.alias("pos"), v.alias("value")),
    )
    scalars = F.filter(
        F.array(*[
            F.when(label[f].isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), as_text(label[f]).alias("value")))
            for f in SCALAR_FIELDS
        ]),
        lambda s: s.isNotNull(),
    )
    return F.filter(F.concat(named, scalars), lambda s: ~s["value"].eqNullSafe(F.lit(NOT_SPECIFIED)))


def merge_chunks(outputs: DataFrame, text: str = "output_text") -> DataFrame:
    """One record per document from ``doc_id, chunk_no`` and a model output.

    ``parties`` are the distinct names in first-seen order, the other fields the first value in chunk
    order; a document without any usable output still gets a record of defaults. Facts are combined
    per (document, field, value) first, so a document with a large share of all chunks is reduced
    map-side and spread over many tasks before its single record is built.
    """
    parsed = outputs.select("doc_id", "chunk_no", first_object(F.col(text)).alias("label"))
    facts = (
        parsed.select("doc_id", "chunk_no", F.explode_outer(_facts(F.col("label"))).alias("fact"))
        .select(
            "doc_id", F.col("fact.field"), F.col("fact.value"),
            F.struct("chunk_no", F.coalesce("fact.pos", F.lit(0)).alias("pos")).alias("seen"),
        )
        .groupBy("doc_id", "field", "value")
        .agg(F.min("seen").alias("seen"))
    )
    named = F.collect_list(F.when(F.col("field") == "parties", F.struct("seen", "value")))

    def first_of(field: str) -> Column:
        mine = F.col("field") == field
        held = F.min_by(F.when(mine, F.struct("value")), F.when(mine, F.col("seen")))
        return F.when(held.isNull(), F.lit(NOT_SPECIFIED)).otherwise(held["value"]).alias(field)

    return facts.groupBy("doc_id").agg(
        F.transform(F.array_sort(named), lambda p: p["value"]).alias("parties"),
        *[first_of(f) for f in SCALAR_FIELDS],
    )
