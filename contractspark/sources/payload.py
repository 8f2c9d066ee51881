"""Uploaded bodies and PDF files as binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PDF_HEAD, PDF_END = "%PDF-", "%%EOF"
NO_HEADER = "No valid PDF header found."


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """``path, modificationTime, length, content`` of the PDF files under a folder."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    )


def accept_uploads(uploads: DataFrame, mime: str = "mime_type") -> DataFrame:
    return uploads.where(F.col(mime) == "application/pdf")


def carve_payload(uploads: DataFrame, body: str = "body", is_base64: str = "is_base64") -> DataFrame:
    """Adds ``payload`` (the bytes from the first PDF header through the last end mark) and ``error``.

    ``body`` is binary; rows flagged base64 are decoded first. Without an end mark the payload runs to
    the end; an end mark only before the header gives an empty payload. The search runs on an
    ISO-8859-1 view, where one character is one byte.
    """
    raw = F.when(F.col(is_base64), F.try_to_binary(F.col(body).cast("string"), F.lit("base64"))).otherwise(F.col(body))
    text: Column = F.col("_body")
    start = F.locate(PDF_HEAD, text)
    tail = F.locate(PDF_END[::-1], F.reverse(text))  # distance of the last end mark from the end
    stop = F.length(text) - tail + 1
    cut = (
        F.when(tail == 0, F.substring(text, start, F.length(text)))
        .when(stop < start, F.lit(""))
        .otherwise(F.substring(text, start, stop - start + 1))
    )
    return (
        uploads.withColumn("_body", F.decode(raw, "ISO-8859-1"))
        .withColumn("payload", F.when(start > 0, F.encode(cut, "ISO-8859-1")))
        .withColumn("error", F.when(F.coalesce(start, F.lit(0)) == 0, F.lit(NO_HEADER)))
        .drop("_body")
    )
