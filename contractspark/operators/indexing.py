"""Exact positions without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, staged

#: Ids by place (``with_row_id``) hold the split above these bits and the row below them, as do places in a written table.
SPLIT_BITS = 33
#: The table of runs is broadcast up to this many rows, and joined by shuffle beyond it.
BROADCAST_RUNS = 200_000


def dense_index(df: DataFrame, id_column: str, index: str, folder: str | None = None) -> DataFrame:
    """Adds the 0-based rank of a bigint id over the whole table; rows without an id come last.

    Rows of one id (or of none) follow each other in no set order. The input is evaluated once: each
    partition is sorted where it lies and written, every row with its place. A run is the rows of one
    partition whose ids agree above 33 bits; the counts of the runs, in id order, add up to offsets.
    Ids by place never overlap between runs, so their rows are not exchanged. Only if runs overlap are
    the written rows dealt by range of (id, place), a pair that is unique, so that neither a repeated
    id nor rows without one meet in a task. ``folder`` is where the tables are written (a new path under
    the shared folder if not given); the result reads them.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "index")
    order = [F.col(id_column).asc_nulls_last()]
    placed = staged(_placed(df.sortWithinPartitions(*order)), f"{folder}/placed")
    runs = staged(_runs(placed, id_column), f"{folder}/runs")
    if not runs.where("_overlaps").isEmpty():
        dealt = placed.repartitionByRange(*order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
        placed = staged(_placed(dealt), f"{folder}/dealt")
        runs = staged(_runs(placed, id_column), f"{folder}/dealt-runs")
    small = runs.count() <= BROADCAST_RUNS
    offsets = runs.select("_block", "_part", "_shift")
    return (
        placed.withColumns(_run_of(id_column))
        .join(F.broadcast(offsets) if small else offsets, ["_block", "_part"])
        .withColumn(index, F.col("_place") + F.col("_shift"))
        .drop("_block", "_part", "_shift", "_place")
    )


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("_place", F.monotonically_increasing_id())


def _run_of(id_column: str) -> dict:
    """A row's run: the upper bits of its id (rows without one come after all others) and its partition."""
    return {
        "_block": F.coalesce(F.shiftright(id_column, SPLIT_BITS), F.lit(1 << SPLIT_BITS)),
        "_part": F.shiftright("_place", SPLIT_BITS),
    }


def _runs(placed: DataFrame, id_column: str) -> DataFrame:
    """One row per run with ``_shift`` (index minus place) and ``_overlaps`` (its ids reach below the run before)."""
    runs = placed.select(id_column, "_place").withColumns(_run_of(id_column)).groupBy("_block", "_part").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_start"),
        F.min(id_column).alias("_first"), F.max(id_column).alias("_last"),
    )
    in_order = Window.orderBy("_block", "_first", "_last", "_part")
    before = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    overlaps = F.coalesce(F.lag("_last").over(in_order) > F.col("_first"), F.lit(False))
    return runs.select("_block", "_part", (before - F.col("_start")).alias("_shift"), overlaps.alias("_overlaps"))
