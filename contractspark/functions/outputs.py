"""Model output texts to label structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, strip, strip_stored


def unfence(text: Column) -> Column:
    """Output text without surrounding backticks and a leading ``json`` tag."""
    return let(strip(strip(text), "`"), _untag)


def _untag(bare: Column) -> Column:
    tagged = F.ltrim(F.substring(bare, F.lit(5), F.length(bare)), F.lit("\n"))
    return F.when(F.startswith(bare, F.lit("json")), tagged).otherwise(bare)


def with_unfenced(outputs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds :func:`unfence` of a column by projections of compiled code; only fenced texts are trimmed."""
    value, tick = F.col(name), F.lit("`")
    fenced = F.startswith(value, tick) | F.endswith(value, tick)
    return (
        outputs.withColumn(name, strip_stored(F.col(text)))
        .withColumn(name, F.when(fenced, strip(value, "`")).otherwise(value))
        .withColumn(name, _untag(value))
    )


def demo_text(text: Column) -> Column:
    """What the demo parses: backticks stripped and the first ``json`` + newline removed."""
    def untag(bare: Column) -> Column:
        at = F.locate("json\n", bare)
        return F.when(
            at > 0, F.concat(F.substring(bare, F.lit(1), at - 1), F.substring(bare, at + 5, F.length(bare)))
        ).otherwise(bare)

    return let(strip(strip(text), "`"), untag)
