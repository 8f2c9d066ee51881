"""Document fingerprints by consistent weighted sampling of word counts.

For each slot, every weighted term draws from its own gamma variables a value that depends on the weight in
a consistent way; the term with the least value is the slot's sample. Two texts agree in a slot with a
probability equal to the generalised Jaccard similarity of their counts: sum of minima over sum of maxima.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

SLOTS = 64
#: Bytes of a fingerprint: two for each slot.
WIDTH = 2 * SLOTS
#: Weighted terms whose draws a task remembers.
REMEMBERED = 150_000
_NEW = 4096
_ROWS = 128
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws of weighted terms, kept in two arrays that are begun anew when full."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.place: dict[bytes | tuple[bytes, int], int] = {}
        self.value = np.empty((REMEMBERED, slots), np.float32)
        self.code = np.empty((REMEMBERED, slots), np.uint16)
        base = np.arange(slots, dtype=np.uint64) * np.uint64(8)
        self.salts = [_mixed((base + np.uint64(k + 1)) * _GOLDEN) for k in range(6)]

    def _draw(self, terms: list, at: int) -> None:
        words = [t if isinstance(t, bytes) else t[0] for t in terms]
        weights = np.log(np.array([1 if isinstance(t, bytes) else t[1] for t in terms], np.float64))[:, None]
        keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[:, None]
        uniform = lambda k: ((_mixed(keys ^ self.salts[k]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        r = -np.log(uniform(0) * uniform(1))
        c = -np.log(uniform(2) * uniform(3))
        beta = uniform(4)
        t = np.floor(weights / r + beta)
        self.value[at : at + len(terms)] = np.log(c) - r * (t - beta) - r
        codes = _mixed((keys ^ self.salts[5]) + t.astype(np.int64).astype(np.uint64) * _GOLDEN)
        self.code[at : at + len(terms)] = (codes >> np.uint64(48)).astype(np.uint16)

    def _learn(self, terms) -> None:
        fresh = [t for t in terms if t not in self.place]
        for i in range(0, len(fresh), _NEW):
            part, at = fresh[i : i + _NEW], len(self.place)
            self._draw(part, at)
            self.place.update(zip(part, range(at, at + len(part))))

    def signature(self, text: str) -> bytes:
        """Two bytes per slot; all zero for a text without words."""
        counts = Counter(text.encode().split())  # bytes split at ASCII white space only
        terms = [w if n == 1 else (w, n) for w, n in counts.items()]
        best, code = np.full(self.slots, np.inf, np.float32), np.zeros(self.slots, np.uint16)
        slot = np.arange(self.slots)
        for i in range(0, len(terms), _NEW):
            part = terms[i : i + _NEW]
            missing = sum(t not in self.place for t in part)
            if len(self.place) + missing > REMEMBERED:
                self.place.clear()
            if missing:
                self._learn(part)
            rows = np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))
            values = self.value[rows]
            least = values.argmin(axis=0)
            value = values[least, slot]
            lower = value < best
            best = np.where(lower, value, best)
            code = np.where(lower, self.code[rows[least], slot], code)
        return code.astype("<u2").tobytes()


@lru_cache(maxsize=1)
def _sampler() -> Sampler:
    return Sampler()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots: the estimate of generalised Jaccard similarity."""
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def fingerprint_documents(docs: DataFrame, keep: list[str], text_column: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """The ``keep`` columns and the fingerprint (binary) of every whole text; a null text has no words."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), text_or_empty(text_column).alias("text"))

    def run(batches):
        sampler = _sampler()
        for batch in batches:
            prints = pa.array([sampler.signature(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), prints], ["row", "fp"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp binary")
    return made.select("row.*", F.col("fp").alias(fingerprint))


# ---- each document beside its successor ------------------------------------------------------------------
def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many characters from the start of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _compared(sampler: Sampler, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following)
    other = sampler.signature(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return len(text), digest, own, other, likeness(own, other), likeness(own, next_print)


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document by descending id: its fingerprint, that of its edited text, and both likenesses.

    The next of the last document is the first. Null ids come last; equal ids are ordered by their text.
    The texts are moved once, into ranges of ids. A task walks its range in order; what reaches over a range
    (its last row, and its first row as the successor of the range before) is written with its text and
    settled afterwards, two rows for each range. A hot id stays in one range, whose rows are streamed.
    """
    text = text_or_empty(text_column)
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    id_type = rows.schema["id"].dataType.simpleString()
    id_arrow: list[pa.DataType] = []

    def table(pid: int, found: list[tuple]) -> pa.RecordBatch:
        """found: kind, id, text, result or six nulls."""
        columns = list(zip(*found))
        arrays = [pa.array([pid] * len(found), pa.int32()), pa.array(columns[0]), pa.array(columns[1], id_arrow[0]), pa.array(columns[2], pa.string())]
        arrays += [pa.array(c, t) for c, t in zip(columns[3:], _TYPES)]
        return pa.RecordBatch.from_arrays(arrays, ["pid", "kind", "id", "text", *_NAMES])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sampler, held = TaskContext.get().partitionId(), _sampler(), None
        for whole in batches:
            id_arrow[:] = [whole.column("id").type]
            for at in range(0, whole.num_rows, _ROWS):
                batch, out = whole.slice(at, _ROWS), []
                for own_id, own_text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    own = sampler.signature(own_text)
                    if held is None:
                        out.append(("first", own_id, own_text, *[None] * 6))
                    else:
                        out.append(("row", held[0], None, *_compared(sampler, held[1], held[2], own_text, own)))
                    held = own_id, own_text, own
                if out:
                    yield table(pid, out)
        if held is not None:
            yield table(pid, [("last", held[0], held[1], *[None] * 6)])

    walked = stage(ordered.mapInArrow(walk, f"pid int, kind string, id {id_type}, text string, {_RESULT}"), "compared")
    edges = walked.where("kind <> 'row'").select("pid", "kind", "id", "text")
    firsts = edges.where("kind = 'first'")
    everyone = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("pid").select(
        "pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.first("pid").over(everyone)).alias("next")
    )  # a row for each range, without texts
    lasts = edges.where("kind = 'last'").join(following, "pid").select("id", "text", "next")
    pairs = lasts.join(firsts.select(F.col("pid").alias("next"), F.col("text").alias("following")), "next").select("id", "text", "following")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in batches:
            out = [
                _compared(sampler, a, sampler.signature(a), b, sampler.signature(b))
                for a, b in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), _TYPES))], ["id", *_NAMES])

    settled = pairs.mapInArrow(settle, f"id {id_type}, {_RESULT}")
    return walked.where("kind = 'row'").select("id", *_NAMES).unionByName(settled).withColumnRenamed("id", id_column)
