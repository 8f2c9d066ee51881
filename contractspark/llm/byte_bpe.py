"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices

LONG_TEXT = 1 << 20
#: A heap entry is rank << 40 | place.
PLACE = (1 << 40) - 1
ONE = struct.Struct("<I").pack
#: Fixed value: the pattern for which ``encode`` knows that a lone space can only begin a pre-token.
SPACES_LEAD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that doesn't lead a word.
SPACE_RUN = regex.compile(r" (?:\s|$)")
_MIX, _SPREAD, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of about four keys.

    Buckets are placed largest first, each at the first displacement that puts its keys on free slots;
    a bucket of one key takes a free slot directly (a negative displacement). A string outside the set
    lands on some slot too, so the key stored there is compared.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(set(hashes.tolist())) < n:
            raise ValueError("keys repeat")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            members[b].append(i)
        self.shift = [0] * self.buckets
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in (b for b in order if len(members[b]) > 1):
            own, start = hashes[members[b]], 0
            while True:
                tries = np.arange(start, start + 256, dtype=np.uint64)
                slots = self._slots(own[None, :], tries[:, None])
                ordered = np.sort(slots, axis=1)
                fits = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(fits.argmax())
                    self.shift[b] = start + at
                    slot_of[members[b]] = slots[at]
                    taken[slots[at]] = True
                    break
                start += 256
        for b, slot in zip(singles, np.flatnonzero(~taken).tolist()):
            self.shift[b] = -1 - slot
            slot_of[members[b]] = slot
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for key, value, slot in zip(keys, values, slot_of.tolist()):
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (shift * np.uint64(_MIX))) * np.uint64(_SPREAD)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        slot = -1 - shift if shift < 0 else (((h ^ (shift * _MIX & _MASK)) * _SPREAD & _MASK) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class BytePairs:
    """Encoder and decoder over a rank file's lines and a pre-token pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.spaces_lead = pattern == SPACES_LEAD
        self.packed = Memo(self._packed, 50_000)
        self.after_space = Memo(self._after_space, 300_000)

    @cached_property
    def whole(self) -> PerfectHash:
        """Only encoders need it, and the two tables of ids by one byte and by two."""
        return PerfectHash(list(self.ranks), list(self.ranks.values()))

    @cached_property
    def letters(self) -> list[int]:
        return [self.ranks[bytes([a])] for a in range(256)]

    @cached_property
    def pairs(self) -> list[int]:
        return [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    def _packed(self, piece: str) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        whole = self.whole.get(raw)
        return ONE(whole) if whole is not None else b"".join(map(ONE, self.merged(raw)))

    def merged(self, raw: bytes) -> list[int]:
        """Ids of the parts after merging the adjacent pair of lowest rank, leftmost first, until none is left."""
        find, pairs, n = self.ranks.get, self.pairs, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: The id of the part that begins at each place, and the rank of its pair with the next part; an entry
        #: of the heap that differs from the latter is out of date.
        ids = [self.letters[b] for b in raw]
        ranks = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])]
        heap = [r << 40 | i for i, r in enumerate(ranks) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & PLACE, top >> 40
            if ranks[i] != r:
                continue
            ids[i] = r
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                ranks[j] = -1
                before[k] = i
                r = ranks[i] = find(raw[i : after[k]], -1)
                if r >= 0:
                    heappush(heap, r << 40 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                r = ranks[h] = find(raw[h:k], -1)
                if r >= 0:
                    heappush(heap, r << 40 | h)
        left, i = [], 0
        while i < n:
            left.append(ids[i])
            i = after[i]
        return left

    def _after_space(self, part: str) -> bytes:
        """The ids of a part and the space before it; a part of several pre-tokens shares the memo of its first."""
        first, *rest = self.pattern.findall(" " + part)
        if not rest:
            return self._packed(first)
        return self.after_space[first[1:]] + b"".join(map(self.packed.__getitem__, rest))

    def _pieces(self, text: str) -> bytes:
        if len(text) < LONG_TEXT:
            return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))
        return b"".join(self.packed[m[0]] for m in self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """Packed ids.

        Where the pattern lets a space before anything but white space only begin a pre-token, and no other
        spaces occur, no pre-token reaches over the place before a space, so the parts between spaces are
        encoded (and remembered) by themselves.
        """
        if not self.spaces_lead or SPACE_RUN.search(text) or len(text) >= LONG_TEXT:
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self.after_space.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _pairs(rank_file: bytes, pattern: str) -> BytePairs:
    return BytePairs(rank_file, pattern)


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Adds the ids of every whole text as one binary: little-endian unsigned 32-bit integers.

    ``path`` is a rank file on the driver; its bytes (under 1 MB whatever the data) are broadcast. A
    null text counts as empty and has empty ids. Rows, order of columns and repeated rows stay; a
    column already named like the result is replaced. No special tokens. ``ids_array`` gives an array.
    """
    return _with_binary(docs, text_column, "string", ids_column, _shared(docs, path), pattern, BytePairs.encode)


def decode(docs: DataFrame, path: str, pattern: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids count as none."""
    return _with_binary(docs, ids_column, "binary", bytes_column, _shared(docs, path), pattern, BytePairs.decode)


def _with_binary(df, source: str, kind: str, target: str, shared, pattern: str, function: Callable) -> DataFrame:
    kept = [c for c in df.columns if c != target]
    given = F.coalesce(F.col(source).cast(kind), F.lit("").cast(kind))
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in kept)).alias("row"), given.alias("given"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, made binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(shared.value, pattern)
        for batch in slices(batches):
            made = pa.array([function(pairs, x) for x in batch.column("given").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], ["row", "made"])

    return rows.mapInArrow(run, schema).select("row.*", F.col("made").alias(target))


def n_ids(ids_column: str = "ids"):
    return (F.octet_length(ids_column) / 4).cast("bigint")


def ids_array(df: DataFrame, ids_column: str = "ids") -> DataFrame:
    """Replaces packed ids by an array of integers."""
    rows = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns if c != ids_column)).alias("row"), F.col(ids_column).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column("given").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.list_(pa.int64()))], ["row", "made"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, made array<bigint>")
    return made.select("row.*", F.col("made").alias(ids_column))
