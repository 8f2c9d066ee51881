"""Document texts and the per-document shape of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import strict_label, with_field_texts
from ..functions.outputs import demo_text
from ..functions.text import or_default, truncate
from ..rules import DEMO_TEXT_CHARS, FIELDS, NOT_SPECIFIED, SCALAR_FIELDS
from .paging import BLOCK_PAGES, page_block, split_by_depth

INVALID_OUTPUT = "Model failed to output valid JSON."
NO_INPUT = "Please provide either text or a PDF."


def doc_text(pages: DataFrame, limit: int = DEMO_TEXT_CHARS, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``doc_id, text``: page texts in order, a newline after each, cut to ``limit`` characters.

    Each page adds at least one character, so pages behind enough others cannot matter. For documents
    longer than one block the blocks beyond the limit are found from block sizes alone and dropped
    before any text is gathered.
    """
    piece = truncate(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), limit)
    short, deep = split_by_depth(pages, block_pages)
    parts = short.select("doc_id", "page_no", piece.alias("piece"))
    if deep is not None:
        cut = deep.pages.select("doc_id", "page_no", page_block(block_pages, deep.first_block).alias("block"), piece.alias("piece"))
        sizes = cut.groupBy("doc_id", "block").agg(F.sum(F.length("piece")).alias("chars"))
        before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        needed = sizes.withColumn("_before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(
            F.col("_before") < limit
        )
        parts = parts.unionByName(cut.join(needed, ["doc_id", "block"], "left_semi").drop("block"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "piece")))
    joined = F.array_join(F.transform(ordered, lambda p: p["piece"]), "")
    return parts.groupBy("doc_id").agg(truncate(joined, limit).alias("text"))


def route_input(requests: DataFrame, limit: int = DEMO_TEXT_CHARS) -> DataFrame:
    """Adds ``raw_text`` (pasted text, or document text when a file was given) and ``error``.

    Input columns: ``input_type, text_input, document_text``.
    """
    pasted = (F.col("input_type") == "Paste Text") & (F.coalesce("text_input", F.lit("")) != "")
    uploaded = (F.col("input_type") == "Upload PDF") & F.col("document_text").isNotNull()
    return requests.withColumn(
        "raw_text",
        F.when(pasted, truncate(F.col("text_input"), limit)).when(uploaded, truncate(F.col("document_text"), limit)),
    ).withColumn("error", F.when(~F.coalesce(pasted | uploaded, F.lit(False)), F.lit(NO_INPUT)))


def parse_or_error(outputs: DataFrame, text: str = "output_text") -> DataFrame:
    """Adds the four fields as text (NULL when not JSON), ``other_fields``, ``error`` and ``raw_output``.

    ``other_fields`` is a map of all other keys of the record, each value of any type; NULL when not JSON.
    """
    parsed, record = F.col("_label").isNotNull(), F.from_json("_text", "map<string,variant>")
    labelled = outputs.withColumn("_text", demo_text(F.col(text))).withColumn("_label", strict_label(F.col("_text")))
    return (
        with_field_texts(labelled, "_label")
        .withColumns({f: F.when(parsed, F.col(f)) for f in FIELDS})
        .withColumn("other_fields", F.when(parsed, F.map_filter(record, lambda k, _: ~k.isin(*FIELDS))))
        .withColumn("error", F.when(~parsed, F.lit(INVALID_OUTPUT)))
        .withColumn("raw_output", F.when(~parsed, F.col(text)))
        .drop("_label", "_text")
    )


def display_defaults(records: DataFrame) -> DataFrame:
    """Merged records for display: ``parties`` joined to one text, anything empty says so."""
    shown = F.array_join(F.col("parties"), ", ", "")
    return records.select(
        "doc_id",
        or_default(shown, NOT_SPECIFIED).alias("parties"),
        *[or_default(F.col(f), NOT_SPECIFIED).alias(f) for f in SCALAR_FIELDS],
    )
