"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words.
GAP = r"[\x20\x09-\x0D]+"
#: Rows that a Python task handles at a time, so that long texts don't add up.
ROWS = 512
#: And bytes of them.
BYTES = 8 << 20
#: Letters of the longest text that a memo keeps, and the average that it allows for.
LONG_KEY, LETTERS_A_KEY = 64, 16


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows to the session's shared folder and reads them again.

    This cuts the lineage and fixes everything computed so far; every executor can read the files.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and, but for single longer rows, ``size`` bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halves(batch.slice(at, rows), size)


def _halves(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halves(batch.slice(0, half), size)
    yield from _halves(batch.slice(half), size)


class Memo(dict):
    """A dict that computes what it lacks; text keys, bounded in entries and in letters.

    It holds at most twice ``limit`` keys and twice ``LETTERS_A_KEY * limit`` letters; keys longer than
    ``LONG_KEY`` are computed anew each time.
    """

    def __init__(self, compute: Callable, limit: int = 250_000):
        self.compute, self.limit, self.older, self.letters = compute, limit, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONG_KEY:
                return value
        if len(self) >= self.limit or self.letters > LETTERS_A_KEY * self.limit:
            self.older, self.letters = dict(self), 0
            self.clear()
        self[key] = value
        self.letters += len(key)
        return value
