"""Degenerate repetition in generated text: where does a chunk start to appear three times in a row?

Spark has no built-in for this: a regular expression needs one back-reference pattern per chunk length
and re-reads the text for each start position. The search runs as a vectorised pandas UDF, and callers
pass NULL for every row that does not need it, so those rows cost nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..rules import LOOP_MAX_LEN, LOOP_MIN_LEN, LOOP_REPEATS, LOOP_STEP
from .text import WHITESPACE


def loop_start(text: str, min_len: int = LOOP_MIN_LEN, repeats: int = LOOP_REPEATS) -> int:
    """0-based start of the loop to cut, or -1. Shortest chunk length first, then leftmost start.

    A chunk of length L starting at s repeats ``repeats`` times exactly when the text agrees with
    itself shifted by L on the (repeats-1)*L characters from s on, so for each L one comparison of two
    array slices and the run lengths of its matches decide all start positions at once. Only the
    lengths found by :func:`_possible_lengths` are compared; for ordinary text there are none. A run that
    begins with a blank chunk is blank throughout, so the first start decides for all of a run.
    """
    n = len(text)
    sizes = _possible_lengths(text, min_len, min(LOOP_MAX_LEN, n // repeats))
    if not sizes:
        return -1
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for size in sizes:
        last = n - size * repeats  # starts must lie before this
        if last <= 0:
            continue
        need = size * (repeats - 1)
        mismatch = np.flatnonzero(chars[:-size] != chars[size:])
        edges = np.concatenate(([-1], mismatch, [n - size]))
        for k in np.flatnonzero(np.diff(edges) - 1 >= need):
            start = int(edges[k]) + 1
            if start < last and text[start:start + size].strip(WHITESPACE):
                return start
    return -1


def _possible_lengths(text: str, gram: int, longest: int) -> list[int]:
    """Chunk lengths L for which some ``gram`` characters at a multiple of ``gram`` recur L later.

    Any chunk at least ``gram`` long covers such a multiple, so no looping length is missed.
    """
    found = set()
    for at in range(0, len(text) - 2 * gram + 1, gram):
        piece, stop = text[at:at + gram], at + longest + gram
        again = text.find(piece, at + gram, stop)
        while again >= 0:
            if (again - at - gram) % LOOP_STEP == 0:
                found.add(again - at)
            again = text.find(piece, again + 1, stop)
    return sorted(found)


@F.pandas_udf(IntegerType())
def _loop_starts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: -1 if t is None else loop_start(t)).astype("int32")


def loop_position(text: Column) -> Column:
    """0-based start of the repetition to cut, -1 when there is none or the text is NULL."""
    return _loop_starts(text)
