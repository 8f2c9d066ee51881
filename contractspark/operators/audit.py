"""Token-length audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, regex_token_count
from ..rules import MAX_SEQ_TOKENS


def token_counts(df: DataFrame, text: str = "text", counter: TokenCounter = regex_token_count) -> DataFrame:
    return df.withColumn("tokens", counter(F.col(text)))


def length_audit(
    df: DataFrame, text: Column, limit: int = MAX_SEQ_TOKENS, counter: TokenCounter = regex_token_count
) -> DataFrame:
    """One row: ``n, p50, p95, max_tokens, over_limit`` with p = sorted[int(n * share)].

    Rows are reduced map-side to a histogram of lengths; only the distinct lengths (bounded by the
    longest text, not by the number of rows) meet in the running sum.
    """
    histogram = df.select(counter(text).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))
    running = histogram.select(
        "tokens", "n", F.sum("n").over(Window.orderBy("tokens")).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )

    def at_share(share: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * F.lit(share)), F.col("tokens")))

    return running.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        at_share(0.5).alias("p50"), at_share(0.95).alias("p95"), F.max("tokens").alias("max_tokens"),
        F.coalesce(F.sum(F.when(F.col("tokens") > limit, F.col("n"))), F.lit(0)).alias("over_limit"),
    )
