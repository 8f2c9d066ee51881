"""Cross-tokenizer alignment: pair-document records in radix-partitioned runs, counted by a k-way heap merge.

Each task aligns its documents and cuts what it finds into runs: the distinct pairs of a run, sorted by
radix part, A id and B id, with their document numbers. The pairs of one part meet in one task, as one packed
stream a run; a heap merges the streams. A's ids come in order, so an id's best count is known when its last
pair has passed, and the counts then flow back to each run as another packed stream. Each run adds them up
for its documents. What is shuffled is one entry a run and distinct pair, however many documents hold it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SPACES_LEAD
from .common import slices, stage
from .token_counts import byte_letters

#: Pair-document records and documents of one run at most (one document's records stay together).
RUN_RECORDS, RUN_DOCS = 1_000_000, 1 << 16
#: Known parts of texts are forgotten beyond so many letters, and longer ones aren't remembered.
MEMO_LETTERS, LONG_PART = 2_000_000, 64
#: Links in a group beyond which its ids are first counted.
LARGE_GROUP = 1 << 12
#: Texts that only the vocabulary's own library encodes.
LONG_TEXT = 10_000
#: Bytes of text for each radix part; 64 to 16,384 parts.
PART_BYTES = 1 << 25
#: A place where neither tokenizer's tokens reach across: before a space between two visible characters.
BOUNDARY = re.compile(r"(?<=[^ ]) (?=\S)")
UNEVEN = re.compile(r"^ | (?:\s|$)")


class Aligner:
    """Aligns the tokens of a byte-level vocabulary (A, tokenizers) with those of a piece model (B, sentencepiece).

    Texts are cut where neither side's tokens reach across; a part is aligned once and remembered.
    """

    def __init__(self, vocabulary: bytes, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        level = file["pre_tokenizer"]
        self.a = Tokenizer.from_str(vocabulary.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        letter = {c: b for b, c in enumerate(byte_letters())}
        vocab = file["model"]["vocab"]
        a_bytes = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        n_a = max(vocab.values()) + 1
        self.a_length = np.array([len(a_bytes.get(i, b"")) for i in range(n_a)], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        #: A's ids before another of the group and before B's, B's ids before another and at the group's end.
        listed = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (len(pieces), ",;")) for mark in marks for i in range(n)]
        self.listed, self.b_listed = np.array(listed, object), 2 * n_a
        self.listed_length = np.array(list(map(len, listed)), np.int64)
        self.n_a, self.n_b = n_a, len(pieces)
        plain = file["normalizer"] is None and level["type"] == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"]
        self.parts = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        merges = [vocab[x + y] for x, y in (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])]
        self.ranks = None
        if plain and all(x < y for x, y in zip(merges, merges[1:])):  # ids rank the merges: the faster library gives the same
            self.ranks = tiktoken.Encoding("a", pat_str=SPACES_LEAD, mergeable_ranks={t: i for i, t in a_bytes.items()}, special_tokens={})
        self.forget()

    def forget(self) -> None:
        """Known parts: text -> number; by number sizes, groups, wholeness, and where its links begin."""
        self.known: dict[str, int] = {}
        self.letters = 0
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.whole = np.zeros(0, bool)
        self.start = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Parts whose forms with a space before them make up a space and the text."""
        if not self.parts:
            return [text]
        return BOUNDARY.split(text) if UNEVEN.search(text) else text.split(" ")

    def _a_ids(self, text: str) -> list[int]:
        if self.ranks and len(text) < LONG_TEXT:
            return self.ranks.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def learn(self, parts: list[str]) -> None:
        """Aligns parts that aren't known and gives them the next numbers."""
        a = [self._a_ids(" " + p) for p in parts]
        b = self.b.encode(parts, num_threads=1)
        raw = [(" " + p).encode() for p in parts]
        flat_b = np.fromiter(chain.from_iterable(b), np.int64)
        whole = np.ones(len(parts), bool)
        if b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != b"".join(raw):
            whole = np.array([b"".join(map(self.b_bytes.__getitem__, y)) == r for y, r in zip(b, raw)])
            a, b = [x if w else [] for x, w in zip(a, whole)], [y if w else [] for y, w in zip(b, whole)]
            flat_b = np.fromiter(chain.from_iterable(b), np.int64)
        flat_a = np.fromiter(chain.from_iterable(a), np.int64)
        size_a, size_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        sizes, texts, pairs, times, links = self._aligned(flat_a, flat_b, size_a, size_b)
        first = len(self.groups)
        self.groups += texts
        self.sizes = np.concatenate([self.sizes, sizes])
        self.whole = np.concatenate([self.whole, whole])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(links)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.known.update(zip(parts, range(first, first + len(parts))))
        self.letters += sum(map(len, raw))

    def _aligned(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        """Of parts laid end to end: sizes, listed groups, pairs with how often they are linked, and how many pairs."""
        n = len(size_a)
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        in_a, in_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        part_of = np.repeat(np.arange(n), size_a)[before_a] if len(both) else np.zeros(0, np.int64)
        linked = in_a * in_b
        sizes = np.stack([size_a, size_b, np.bincount(part_of, minlength=n), _added(part_of, linked, n)], axis=1)
        # the groups' text: A's ids of a group, then B's
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.arange(len(a)) == (before_a + in_a - 1)[of_a], np.arange(len(b)) == (before_b + in_b - 1)[of_b]
        order[np.arange(len(a)) + before_b[of_a]] = a + self.n_a * last_a
        order[np.arange(len(b)) + (before_a + in_a)[of_b]] = self.b_listed + b + self.n_b * last_b
        text = "".join(self.listed[order].tolist())
        ends = np.concatenate([[0], np.cumsum(self.listed_length[order])])[np.concatenate([[0], np.cumsum(size_a + size_b)])].tolist()
        texts = [text[x:y] for x, y in zip(ends, ends[1:])]
        # links: every id of A in a group with every one of B; in large groups by distinct ids
        few = np.flatnonzero(linked <= LARGE_GROUP)
        each = linked[few]
        group = np.repeat(few, each)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        pairs = a[before_a[group] + nth // in_b[group]] << 20 | b[before_b[group] + nth % in_b[group]]
        times, owner = np.ones(len(pairs), np.int64), part_of[group]
        for g in np.flatnonzero(linked > LARGE_GROUP).tolist():
            x, m = np.unique(a[before_a[g] : before_a[g] + in_a[g]], return_counts=True)
            y, k = np.unique(b[before_b[g] : before_b[g] + in_b[g]], return_counts=True)
            pairs = np.concatenate([pairs, (x[:, None] << 20 | y[None, :]).ravel()])
            times = np.concatenate([times, (m[:, None] * k[None, :]).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), part_of[g])])
        by = np.argsort(owner, kind="stable")
        return sizes, texts, pairs[by], times[by], np.bincount(owner, minlength=n)

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text ``n_a, n_b, n_groups, n_links, groups``; and of all: pairs, their texts' places, how often linked."""
        if self.letters > MEMO_LETTERS:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        if fresh := list({p: None for parts in split for p in parts if p not in known}):
            self.learn(fresh)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        own = np.fromiter((known[p] for parts in split for p in parts), np.int64, int(lengths.sum()))
        place = np.repeat(np.arange(len(split)), lengths)
        whole = np.bincount(place, weights=~self.whole[own], minlength=len(split)) == 0
        own, place = own[whole[place]], place[whole[place]]
        sizes = np.stack([_added(place, self.sizes[own, c], len(split)) for c in range(4)], axis=1).tolist()
        ends = np.searchsorted(place, np.arange(len(split) + 1)).tolist()
        numbers, get = own.tolist(), self.groups.__getitem__
        listed = ["".join(map(get, numbers[x:y]))[:-1] if y > x else None for x, y in zip(ends, ends[1:])]
        rows = [(*size, text) for size, text in zip(sizes, listed)]
        key, amount = np.unique(place << 32 | own, return_counts=True)
        own, place = key & 0xFFFFFFFF, key >> 32
        links = np.diff(self.start)[own]
        at = np.repeat(self.start[own] - (np.cumsum(links) - links), links) + np.arange(links.sum())
        result = rows, *_summed(self.pairs[at], np.repeat(place, links), self.times[at] * np.repeat(amount, links))
        for p in fresh:
            if len(p) > LONG_PART:
                del known[p]
        return result


def _added(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by place."""
    made = np.zeros(n, np.int64)
    np.add.at(made, of, values)
    return made


def _summed(pairs: np.ndarray, places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One record for each text and pair, by pair."""
    key = pairs << 20 | places
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at] >> 20, key[at] & 0xFFFFF, np.add.reduceat(times[order], at) if len(at) else at


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, as unsigned 64-bit differences (the first) and numbers, by byte so that they pack well."""
    flat = [np.diff(columns[0], prepend=0), *columns[1:]]
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in flat)
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(columns[0])], "<u8").tobytes() + planes)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    planes = np.frombuffer(raw[8:], np.uint8).reshape(-1, 8, n) if n else np.zeros((3, 8, 0), np.uint8)
    flat = [np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.int64) for p in planes]
    return [np.cumsum(flat[0]), *flat[1:]]


@lru_cache(maxsize=1)
def _aligner(vocabulary: bytes, model: bytes) -> Aligner:
    return Aligner(vocabulary, model)


_RECORD = "run string, part int, packed binary, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
#: Rows of a run that aren't a part's pairs: its documents, and its document numbers by pair.
DOC, PLACES = -2, -1


def _runs(rows: DataFrame, vocabulary, model, n_parts: int) -> DataFrame:
    """One row per document (part ``DOC``), and for each run one per part, and one with its pairs' documents."""
    kind = rows.schema["id"].dataType.simpleString()

    def finished(run: str, records: list[tuple], id_type) -> Iterator[pa.RecordBatch]:
        pairs, places, times = (np.concatenate(c) for c in zip(*records)) if records else (np.zeros(0, np.int64),) * 3
        part = (pairs >> 20) % n_parts
        order = np.lexsort((places, pairs, part))
        pairs, places, times, part = pairs[order], places[order], times[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        held = np.diff(np.append(at, len(pairs)))
        key, of = pairs[at], part[at]
        first = _pack(held)
        made = [(PLACES, len(first).to_bytes(8, "little") + first + _pack(places, times))]
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        for start, end in zip(edges.tolist(), np.append(edges[1:], len(of)).tolist()):
            made.append((int(of[start]), _pack(key[start:end], held[start:end])))
        yield batch_of([run] * len(made), [m[0] for m in made], [m[1] for m in made], pa.nulls(len(made), id_type), [None] * len(made), [(None,) * 4] * len(made), [None] * len(made))

    def batch_of(run, part, packed, ids, place, sizes, digest) -> pa.RecordBatch:
        columns = [pa.array(run, pa.string()), pa.array(part, pa.int32()), pa.array(packed, pa.binary()), pa.array(place, pa.int64())]
        columns += [pa.array(c, pa.int64()) for c in zip(*sizes)] + [pa.array(digest, pa.string()), ids]
        return pa.RecordBatch.from_arrays(columns, ["run", "part", "packed", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary.value, model.value)
        name, records, docs, size, id_type = uuid.uuid4().hex, [], 0, 0, None
        for batch in slices(batches):
            id_type = batch.column("id").type
            found, pairs, places, times = aligner.align(batch.column("text").to_pylist())
            n = len(found)
            digests = [hashlib.sha256(f[4].encode()).hexdigest() if f[4] is not None else "" for f in found]
            yield batch_of([name] * n, [DOC] * n, [None] * n, batch.column("id"), range(docs, docs + n), [f[:4] for f in found], digests)
            records.append((pairs, places + docs, times))
            docs, size = docs + n, size + len(pairs)
            if size > RUN_RECORDS or docs > RUN_DOCS:
                yield from finished(name, records, id_type)
                name, records, docs, size = uuid.uuid4().hex, [], 0, 0
        if docs:
            yield from finished(name, records, id_type)

    return rows.mapInArrow(run, f"{_RECORD}, id {kind}")


def _stream(run: int, blob: bytes) -> Iterator[tuple[int, int, int]]:
    keys, held = _unpack(blob)
    for at in range(0, len(keys), 4096):
        yield from zip(keys[at : at + 4096].tolist(), [run] * 4096, held[at : at + 4096].tolist())


def _merge(part: tuple, table: pa.Table) -> pa.Table:
    """Counts every pair of a part over its runs, and returns to each run its pairs' counts, times two, plus one for the best."""
    runs = table.column("run").to_pylist()
    back = [array("Q") for _ in runs]
    merged = heapq.merge(*(_stream(i, b) for i, b in enumerate(table.column("packed").to_pylist())))
    for _, pairs in groupby(merged, key=lambda e: e[0] >> 20):
        counted: list[tuple[int, list[int]]] = []
        last = -1
        for key, run, held in pairs:
            if key == last:
                total += held
                in_runs.append(run)
                continue
            if last >= 0:
                counted.append((total, in_runs))
            last, total, in_runs = key, held, [run]
        counted.append((total, in_runs))
        best = max(counted)[0]
        for total, in_runs in counted:
            value = total << 1 | (total == best)
            for run in in_runs:
                back[run].append(value)
    compress = zstandard.ZstdCompressor(level=1).compress
    packed = [compress(b.tobytes()) for b in back]
    return pa.table({"run": pa.array(runs, pa.string()), "part": table.column("part"), "packed": pa.array(packed, pa.binary())})


def _contributions(run: tuple, table: pa.Table) -> pa.Table:
    """A run's documents with the counts that came back for their links."""
    parts = table.column("part").to_numpy()
    packed = table.column("packed")
    docs = table.filter(pa.array(parts == DOC))
    place = docs.column("place").to_numpy()
    n_best, count_sum = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    returned = sorted((p, i) for i, p in enumerate(parts.tolist()) if p >= 0)
    if returned:
        blob = packed[parts.tolist().index(PLACES)].as_py()
        cut = 8 + int.from_bytes(blob[:8], "little")
        (held,), (of, times) = _unpack(blob[8:cut]), _unpack(blob[cut:])
        values = np.concatenate([np.frombuffer(zstandard.decompress(packed[i].as_py()), "<u8") for _, i in returned]).astype(np.int64)
        values = np.repeat(values, held)
        np.add.at(count_sum, of, (values >> 1) * times)
        np.add.at(n_best, of, (values & 1) * times)
    made = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return made.append_column("n_best", pa.array(n_best[place])).append_column("count_sum", pa.array(count_sum[place]))


def align(docs: DataFrame, vocabulary_path: str, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A and B encode a space and the text; where tokens of both end, a group ends, and every A token of a
    group is linked with every B token of it. A pair of ids counts the rows that hold it linked; ``n_best``
    are the links whose count is the highest of their A id (ties too), ``count_sum`` adds the counts over the
    links. Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. Repeated rows count as documents of their own; null ids stay; an empty table
    gives none; other columns are not read. Both files are read on the driver and broadcast (3 MB whatever
    the data).
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as a, open(model_path, "rb") as b:
        files = spark.sparkContext.broadcast(a.read()), spark.sparkContext.broadcast(b.read())
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n_parts = 1 << min(14, max(6, (size // PART_BYTES).bit_length()))
    made = stage(_runs(rows, *files, n_parts), "runs")
    streams = made.where("part >= 0").select("run", "part", "packed")
    back = streams.groupBy("part").applyInArrow(_merge, "run string, part int, packed binary")
    kept = made.where("part < 0")
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema if f.name not in back.columns]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return kept.unionByName(back.select("*", *absent)).groupBy("run").applyInArrow(_contributions, schema)
