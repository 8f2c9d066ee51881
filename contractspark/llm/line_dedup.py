"""Line dedup by reference counts: sharded cuckoo filters in front of exact tables; documents can be taken out again.

The index has three tables. ``refs`` holds which document holds which line, ``counts`` each line's number
of documents and the largest of them, ``filters`` one chain of cuckoo filters per shard of the line keys.
A filter tells which lines of a new batch can't be in the index, so only the others meet the exact tables.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage

#: White space that is stripped from a line's ends.
BLANK = " \t\n\x0b\x0c\r"
#: Line keys that one shard is meant for.
SHARD_KEYS = 1 << 18
#: Parts that the documents of one line are dealt over.
SALTS = 16


class CuckooFilter:
    """A chain of cuckoo filters: 16-bit marks, four to a bucket, each in one of two buckets; supports removal.

    Every key put in holds a mark of its own, so that taking one out never hides another. A full link is
    followed by a new one of the same size.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1 << 12, links: list[array] | None = None):
        self.buckets, self.links = buckets, links or [array("H", bytes(2 * self.SLOTS * buckets))]

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        raw = zstandard.decompress(blob)
        buckets, n = np.frombuffer(raw[:16], np.int64).tolist()
        size = 2 * cls.SLOTS * buckets
        return cls(buckets, [array("H", raw[16 + i * size : 16 + (i + 1) * size]) for i in range(n)])

    def dump(self) -> bytes:
        head = np.array([self.buckets, len(self.links)], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(link.tobytes() for link in self.links))

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        at = key & (self.buckets - 1)
        return mark, at, at ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def __contains__(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return any(mark in link[4 * a : 4 * a + 4] or mark in link[4 * b : 4 * b + 4] for link in self.links)

    def add(self, key: int) -> None:
        mark, a, b = self._places(key)
        link = self.links[-1]
        for at in (a, b):
            for slot in range(4 * at, 4 * at + 4):
                if not link[slot]:
                    link[slot] = mark
                    return
        moved, at = [], b
        for kick in range(self.KICKS):
            slot = 4 * at + (mark + kick) % 4
            moved.append((slot, link[slot]))
            link[slot], mark = mark, link[slot]
            at ^= mark * 0x5BD1E995 & (self.buckets - 1)
            for free in range(4 * at, 4 * at + 4):
                if not link[free]:
                    link[free] = mark
                    return
        for slot, old in reversed(moved):
            link[slot] = old
        self.links.append(array("H", bytes(2 * self.SLOTS * self.buckets)))
        self.add(key)

    def remove(self, key: int) -> None:
        """Takes out one mark; the key must have been put in."""
        mark, a, b = self._places(key)
        for link in self.links:
            for at in (a, b):
                for slot in range(4 * at, 4 * at + 4):
                    if link[slot] == mark:
                        link[slot] = 0
                        return
        raise KeyError(key)


# ---- lines -------------------------------------------------------------------------------------------------
def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of the line, stripped and with A-Z lowered; none if it has fewer code points."""
    line = line.strip(BLANK)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def references(docs: DataFrame, n_shards: int, min_chars: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``shard, key, doc_id, lines``: each document's keys with how many of its lines have them."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, keys, lines = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found: dict[bytes, int] = {}
                for line in (text or "").split("\n"):
                    if key := line_key(line, min_chars):
                        found[key] = found.get(key, 0) + 1
                at += [i] * len(found)
                keys += found
                lines += found.values()
            shard = pa.array([int.from_bytes(k[:4]) % n_shards for k in keys], pa.int32())
            ids = batch.column("doc_id").take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([shard, pa.array(keys, pa.binary()), ids, pa.array(lines, pa.int64())], ["shard", "key", "doc_id", "lines"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"shard int, key binary, doc_id {kind}, lines bigint")
    return found.groupBy("shard", "key", "doc_id").agg(F.sum("lines").alias("lines"))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))


# ---- the index ---------------------------------------------------------------------------------------------
def _number(key: bytes) -> int:
    return int.from_bytes(key[8:])


def _changed(filters: DataFrame, keys: DataFrame, change: str) -> DataFrame:
    """The filters after putting in (``add``) or taking out (``remove``) the keys of their shards."""

    def run(shard, held: pa.Table, given: pa.Table) -> pa.Table:
        own = CuckooFilter.load(held.column("filter")[0].as_py()) if held.num_rows else CuckooFilter()
        act = getattr(own, change)
        for key in given.column("key").to_pylist():
            act(_number(key))
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "filter": pa.array([own.dump()], pa.binary())})

    return filters.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard")).applyInArrow(run, "shard int, filter binary")


def _possible(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """``shard, key`` of the keys that the filters may hold."""

    def run(shard, held: pa.Table, given: pa.Table) -> pa.Table:
        if not held.num_rows or not given.num_rows:
            return given.slice(0, 0)
        own = CuckooFilter.load(held.column("filter")[0].as_py())
        return given.filter(pa.array([_number(k) in own for k in given.column("key").to_pylist()], pa.bool_()))

    return filters.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard")).applyInArrow(run, "shard int, key binary")


@dataclass(frozen=True)
class LineIndex:
    """An immutable state; ``insert`` and ``delete`` write the tables of the next one to the shared folder."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_chars: int

    @classmethod
    def empty(cls, spark: SparkSession, expected_lines: int, min_chars: int = 20, id_type: str = "bigint") -> LineIndex:
        """``expected_lines`` sets the number of shards (16 at least); more lines only lengthen the filters' chains."""
        none = lambda schema: spark.createDataFrame([], schema)
        refs = none(f"shard int, key binary, doc_id {id_type}, lines bigint")
        counts = none(f"shard int, key binary, n_docs bigint, top_doc {id_type}")
        return cls(refs, counts, none("shard int, filter binary"), max(16, ceil(expected_lines / SHARD_KEYS)), min_chars)

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LineIndex:
        """The index with these documents; a line that a document is already recorded with changes nothing."""
        given = stage(references(docs, self.n_shards, self.min_chars, id_column, text_column), "given")
        batch = stage(_counted(given), "batch")
        possible = stage(_possible(self.filters, batch), "possible")
        on = ["shard", "key"]
        met = self.refs.join(possible, on, "left_semi")
        again = given.join(possible, on, "left_semi").alias("g").join(
            met.alias("m"), [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*on, "doc_id")], "left_anti"
        )
        surely_new = given.join(possible, on, "left_anti")
        refs = stage(self.refs.unionByName(surely_new).unionByName(again), "refs")
        old = self.counts.join(possible, on, "left_semi")
        merged = old.unionByName(_counted(again)).groupBy(*on).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))
        untouched = self.counts.join(possible, on, "left_anti")
        counts = stage(untouched.unionByName(merged).unionByName(batch.join(possible, on, "left_anti")), "counts")
        fresh = batch.join(old, on, "left_anti")
        filters = stage(_changed(self.filters, fresh, "add"), "filters")
        return LineIndex(refs, counts, filters, self.n_shards, self.min_chars)

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids (a null id is one, too); unknown ids change nothing."""
        gone_ids = ids.select(F.col(id_column).alias("gone")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        on = ["shard", "key"]
        refs = stage(self.refs.join(gone_ids, same, "left_anti"), "refs")
        touched = stage(self.refs.join(gone_ids, same, "left_semi").select(*on).distinct(), "touched")
        left = stage(_counted(refs.join(touched, on, "left_semi")), "left")
        counts = stage(self.counts.join(touched, on, "left_anti").unionByName(left), "counts")
        filters = stage(_changed(self.filters, touched.join(left, on, "left_anti"), "remove"), "filters")
        return LineIndex(refs, counts, filters, self.n_shards, self.min_chars)

    def repeated(self, least: int) -> DataFrame:
        """``doc_id, keys``: the lines that a document loses because ``least`` documents hold them, one of a larger id."""
        often = self.counts.where(F.col("n_docs") >= least).select("shard", "key", "top_doc")
        often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        refs = self.refs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        lost = refs.join(often, ["shard", "key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, index: LineIndex, least: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with their text less repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is its text, stripped of ASCII white space and with A-Z lowered; keys of at least
    ``index.min_chars`` code points that ``least`` documents of the index hold stay only in the largest id
    that holds them (all its lines). Lines are parted by ``\\n``; other lines stay, in order. A null or empty
    text is one empty line. Rows of one id are one document and share its fate; rows without an id are one
    document, smaller than all others. Keys are compared by 128-bit digests. An empty table gives none; other
    columns stay, but those named like the two new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_column, "n_lines", "n_dropped")]
    lost = index.repeated(least).withColumnRenamed("doc_id", "lost_of")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in kept)).alias("row"), F.coalesce(docs[f"`{text_column}`"].cast("string"), F.lit("")).alias("text"))
    rows = rows.join(lost, F.col(f"row.{id_column}").eqNullSafe(F.col("lost_of")), "left").select("row", "text", "keys")
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if keys:
                    keys = set(keys)
                    lines = [x for x in lines if line_key(x, min_chars) not in keys]
                    text = "\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(text)
            made = [batch.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["row", "made", "n_lines", "n_dropped"])

    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"row {kind}, made string, n_lines bigint, n_dropped bigint")
    return made.select("row.*", F.col("made").alias(text_column), "n_lines", "n_dropped")
