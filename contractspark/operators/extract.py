"""The model hook: a user function over batches of texts, run inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.messages import render_prompt
from ..rules import SERVING_SYSTEM

BatchModel = Callable[[Sequence[str]], Sequence[str | None]]
OK, FAILED, PARTIAL = "ok", "failed", "partial"
_ERROR_CHARS = 500
_ADDED = {"output_text": StringType(), "status": StringType(), "error": StringType(), "attempts": IntegerType()}


def extract(
    df: DataFrame, load: Callable[[], BatchModel], text: str = "chunk_text", system_text: str = SERVING_SYSTEM
) -> DataFrame:
    """Adds ``output_text, status, error, attempts`` by running a batch function over the rendered prompts.

    ``load`` is called once per task and returns the batch function; if it raises, the task fails, because
    nothing could be extracted. When the function raises for a batch, or returns another number of outputs,
    the batch is halved until the failing rows are alone: these get ``failed``, the error's text and no
    output, all others keep their outputs. ``attempts`` counts the calls a row was part of. Columns of the
    same names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in _ADDED]
    schema = StructType([*kept, *(StructField(name, kind) for name, kind in _ADDED.items())])
    columns = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = run_halving(model, pdf["_prompt"].tolist())
            yield pdf.assign(**dict(zip(_ADDED, zip(*rows))))[columns] if rows else pdf.assign(**dict.fromkeys(_ADDED))[columns]

    return df.withColumn("_prompt", render_prompt(F.col(text), system_text)).mapInPandas(run, schema)


def run_halving(model: BatchModel, prompts: Sequence[str]) -> list[tuple[str | None, str, str | None, int]]:
    """``output, status, error, attempts`` of each prompt; k failing ones among n cost about 2 k log n calls."""
    rows: list[tuple[str | None, str, str | None, int]] = []
    todo = [(0, len(prompts), 1)] if prompts else []
    while todo:
        start, end, attempt = todo.pop()
        try:
            outputs = list(model(prompts[start:end]))
            if len(outputs) != end - start:
                raise ValueError(f"the model returned {len(outputs)} outputs for {end - start} prompts")
        except Exception as error:
            if end - start == 1:
                rows.append((None, FAILED, f"{type(error).__name__}: {error}"[:_ERROR_CHARS], attempt))
            else:
                middle = (start + end) // 2
                todo += [(middle, end, attempt + 1), (start, middle, attempt + 1)]
        else:
            rows += [(output, OK, None, attempt) for output in outputs]
    return rows


def document_status(extracted: DataFrame, id_column: str = "doc_id", order: str = "chunk_no") -> DataFrame:
    """Per document ``n_chunks, n_failed, status`` (ok, partial or failed) and the ``error`` of its first failed chunk.

    Combined map-side from the status columns alone; no output text is shuffled.
    """
    failed = F.col("status") == FAILED
    counted = extracted.groupBy(id_column).agg(
        F.count("*").alias("n_chunks"), F.count_if(failed).alias("n_failed"),
        F.min(F.when(failed, F.struct(F.col(order).alias("at"), F.col("error").alias("error")))).alias("first"),
    )
    status = F.when(F.col("n_failed") == 0, OK).when(F.col("n_failed") == F.col("n_chunks"), FAILED).otherwise(PARTIAL)
    return counted.select(id_column, "n_chunks", "n_failed", status.alias("status"), F.col("first.error").alias("error"))
