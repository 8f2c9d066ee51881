"""Telling documents of a bounded number of pages from longer ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_PAGES = 4096
BROADCAST_DOCS = 100_000  # long-document ids broadcast up to this count, joined by shuffle beyond it


class DeepPages(NamedTuple):
    pages: DataFrame
    first_block: int
    last_block: int


def page_block(block_pages: int, of_null: int | None = None) -> Column:
    """Block of a page; pages without a number, which come before all others, are in block ``of_null``."""
    return F.coalesce(F.floor(F.col("page_no") / block_pages), F.lit(of_null).cast("bigint"))


def split_by_depth(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> tuple[DataFrame, DeepPages | None]:
    """(pages of documents whose page numbers all lie in [0, block_pages) or are null, pages of all others).

    The second part is None when there are no such documents. One job counts the documents with a page
    number outside the first block; it reads two columns, and the filter reaches the Parquet row-group
    statistics, so it is cheap when all documents are short.
    """
    outside = pages.where((F.col("page_no") < 0) | (F.col("page_no") >= block_pages)).select("doc_id", "page_no")
    found = outside.groupBy("doc_id").agg(
        F.min(page_block(block_pages)).alias("low"), F.max(page_block(block_pages)).alias("high")
    )
    docs, low, high = found.agg(F.count("*"), F.min("low"), F.max("high")).first()
    if docs == 0:
        return pages, None
    ids = found.select("doc_id")
    if docs <= BROADCAST_DOCS:
        ids = F.broadcast(ids)
    deep = DeepPages(pages.join(ids, "doc_id", "left_semi"), min(low, 0) - 1, high)
    return pages.join(ids, "doc_id", "left_anti"), deep
