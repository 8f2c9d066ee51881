"""Token counting. An exact model tokenizer is passed in as a column function (e.g. a pandas UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_WORD_OR_SPACE

TokenCounter = Callable[[Column], Column]

_TOKEN = rf"[\p{{L}}\p{{N}}_]+|{NOT_WORD_OR_SPACE}"


def regex_token_count(text: Column) -> Column:
    """One token per run of letters, digits and underscores and one per other visible character."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("bigint")
