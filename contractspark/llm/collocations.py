"""Phrase collocations: an FM-index per shard enumerates the short phrases, their counts are summed over the shards.

A shard is a slice of one language's texts as a sequence of word ids, pieces parted by a separator; its
dictionary is its own. Only its BWT and dictionary are kept. Phrases grow a word at a time in both
directions: a phrase's interval lies inside its prefix's (extension to the right) and is reached from its
suffix's by a backward step (extension to the left), so a phrase is followed only while both are frequent.
What is frequent is a fact of all shards, hence the passes: pairs are summed first, then triples, then the
longer phrases, by 128-bit digest; bit maps of fixed size tell the next pass which to follow. The maps err on
one side only, so they save work and never lose a phrase. A last pass takes each frequent phrase's text from
one shard that holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_or_empty

#: Text of one shard; a task holds two of them at most.
SHARD_BYTES = 8 << 20
#: Rows that a task hands over at a time.
OUT_ROWS = 1 << 16
#: Bits in a map of frequent phrases: 8 MB, whatever the data.
MAP_BITS = 1 << 26
WORD, GAP, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = GAP
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SPREAD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# ---- one shard ---------------------------------------------------------------------------------------------
def word_sequence(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word ids from 1 with a 0 after each piece, and the words by id - 1."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = kind == WORD
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) if len(raw) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends + 1 - starts)]).astype(np.int64)
    letters = _LOWER[raw[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    coded = words.dictionary_encode()
    breaks = np.cumsum(kind == BREAK)[starts] if len(starts) else np.zeros(0, np.int64)
    parted = np.cumsum(np.concatenate([[0], breaks[1:] != breaks[:-1]])) if len(starts) else breaks
    made = np.zeros(len(starts) + (int(parted[-1]) if len(starts) else 0) + 1, np.int64)
    made[np.arange(len(starts)) + parted] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return made, coded.dictionary.cast(pa.string())


def bwt(ids: np.ndarray, depth: int) -> np.ndarray:
    """The symbols before the suffixes, which are sorted by their first ``depth`` symbols (ties anyhow)."""
    rank, reach = ids, 1
    while True:
        order = np.argsort(rank, kind="stable") if reach >= depth else None
        if order is not None:
            return ids[order - 1].astype(np.int32)
        step = min(reach, depth - reach)
        key = rank * (int(rank.max()) + 1) + np.concatenate([rank[step:], np.zeros(step, np.int64)])[: len(rank)]
        by = np.argsort(key)
        ranked = key[by]
        rank = np.empty_like(rank)
        rank[by] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        reach += step


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """Two 64-bit lanes of a digest for each word."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    digests = b"".join(xxhash.xxh3_128_digest(w, seed) for w in words.cast(pa.binary()).to_pylist())
    return np.frombuffer(digests, np.uint64).reshape(-1, 2).T


def phrases(column: np.ndarray, hashes: np.ndarray, follow: Callable[[int, np.ndarray], np.ndarray], depth: int):
    """Yields for each length from 1 the phrases that ``follow(length, hashes)`` lets live.

    A tuple of length, counts, id of the first word, place of the suffix (the phrase without its first word)
    in the previous tuple, and hashes in two lanes. ``column`` is a BWT of at least this depth.
    """
    back = np.argsort(column, kind="stable").astype(np.int32)
    counts = np.bincount(column, minlength=hashes.shape[1] + 1)
    first = np.repeat(np.arange(-1, hashes.shape[1], dtype=np.int32), counts)
    live = follow(1, hashes)
    ids = np.append(_numbered(live), np.int32(-1))[first]
    rows = np.flatnonzero(ids >= 0).astype(np.int32)
    known = hashes[:, live]
    yield 1, counts[1:][live], np.flatnonzero(live), np.zeros(int(live.sum()), np.int32), known
    for length in range(2, depth + 1):
        suffix = ids[back[rows]]
        followed = suffix >= 0
        rows, suffix = rows[followed], suffix[followed]
        if not len(rows):
            return
        prefix = ids[rows]
        new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])])
        at = np.flatnonzero(new).astype(np.int32)
        counts = np.diff(np.append(at, np.int32(len(rows))))
        leads, tails = first[rows[at]], suffix[at]
        del prefix, suffix, followed
        mixed = np.empty((2, len(at)), np.uint64)
        for lane in range(2):
            value = known[lane][tails]
            value ^= hashes[lane][leads] * _MIX[lane]
            value *= _SPREAD[lane]
            value ^= value >> np.uint64(29)
            mixed[lane] = value
        live = follow(length, mixed)
        of = np.cumsum(new, dtype=np.int32) - 1
        if length < depth:
            ids = np.full(len(column), -1, np.int32)
            ids[rows] = _numbered(live)[of]
            rows = rows[live[of]]
        known = mixed[:, live]
        yield length, counts[live], leads[live], tails[live], known


def _numbered(live: np.ndarray) -> np.ndarray:
    """Places among the living, -1 for the others."""
    return np.where(live, np.cumsum(live, dtype=np.int32) - 1, -1).astype(np.int32)


# ---- bit maps of fixed size --------------------------------------------------------------------------------
def bit_map(keys: DataFrame) -> np.ndarray:
    """Three bits per 64-bit key; at most ``MAP_BITS / 64`` numbers come to the driver, however many keys there are."""
    places = F.explode(F.array(*(F.shiftrightunsigned("h", s).bitwiseAND(MAP_BITS - 1) for s in (0, 19, 38)))).alias("bit")
    held = keys.select(places).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
    table = held.toArrow()
    made = np.zeros(MAP_BITS // 64, np.int64)
    made[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return made.view(np.uint64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for shift in (0, 19, 38):
        place = (hashes >> np.uint64(shift)) & np.uint64(MAP_BITS - 1)
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


# ---- Spark -------------------------------------------------------------------------------------------------
SHARD_SCHEMA = "shard bigint, lang string, words array<string>, counts array<bigint>, bwt binary"


def shards(docs: DataFrame, depth: int, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """One row per shard: a number of its own, its language (null: ``und``), its words with their counts, and its packed BWT."""
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_column).alias("text"))
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("bwt", pa.binary())])

    def built(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        text = b"\n".join(texts)
        for part in _cut(text, SHARD_BYTES):
            ids, words = word_sequence(part)
            if len(words):
                column = bwt(ids, depth)
                counts = np.bincount(column, minlength=len(words) + 1)[1:]
                packed = zstandard.ZstdCompressor(level=1).compress(column.tobytes())
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_pylist([{"shard": uuid.uuid4().int >> 65, "lang": lang, "words": words.to_pylist(), "counts": counts.tolist(), "bwt": packed}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
                if sum(sizes.values()) > 2 * SHARD_BYTES or sizes[lang] > SHARD_BYTES:
                    fullest = max(sizes, key=sizes.get)
                    sizes.pop(fullest)
                    yield from built(fullest, held.pop(fullest))
        for lang, texts in held.items():
            yield from built(lang, texts)

    return rows.mapInArrow(run, SHARD_SCHEMA)


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size``, each ending at a line; a longer line stays whole."""
    start = 0
    while len(text) - start > 2 * size:
        end = text.find(b"\n", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


def _each_shard(made: DataFrame, maps: dict[int, np.ndarray], depth: int, collect: Callable, schema: str) -> DataFrame:
    """Runs ``collect(shard, lang, words, levels)`` over the shards; ``levels`` yields what ``phrases`` does."""
    shared = made.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        follow = lambda length, hashes: may_hold(bits[length], hashes[0]) if length in bits else np.ones(hashes.shape[1], bool)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, words = batch.column("shard")[i].as_py(), batch.column("lang")[i].as_py(), batch.column("words")[i].values
                column = np.frombuffer(zstandard.decompress(batch.column("bwt")[i].as_py()), np.int32)
                yield from collect(shard, lang, words, phrases(column, word_hashes(words, lang), follow, depth))
                pa.default_memory_pool().release_unused()

    return made.select("shard", "lang", "words", "bwt").mapInArrow(run, schema)


def _digests(lengths: range) -> Callable:
    """Collects phrases of these lengths as digest and count."""

    def collect(shard, lang, words, levels):
        for k, counts, _, _, hashes in levels:
            if k in lengths:
                lanes = [pa.array(lane.view(np.int64)) for lane in hashes]
                made = pa.RecordBatch.from_arrays([*lanes, pa.array(counts.astype(np.int64)), pa.array(np.full(len(counts), shard))], ["h", "c", "n", "shard"])
                yield from slices([made], OUT_ROWS)

    return collect


def _in_shard(hashes: np.ndarray, shard: int) -> np.ndarray:
    return hashes ^ np.uint64(shard)


def _texts(chosen) -> Callable:
    """Collects the texts of the phrases that are to be taken from their shard."""

    def collect(shard, lang, words, levels):
        texts = None
        for k, counts, first, tails, hashes in levels:
            lead = words.take(pa.array(first))
            texts = lead if k == 1 else pc.binary_join_element_wise(lead, texts.take(pa.array(tails)), " ")
            if k > 1:
                own = np.flatnonzero(may_hold(chosen.value, _in_shard(hashes[0], shard)))
                lanes = [pa.array(np.ascontiguousarray(lane[own]).view(np.int64)) for lane in hashes]
                names = [pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), k, np.int32))]
                made = pa.RecordBatch.from_arrays([*lanes, *names, texts.take(pa.array(own))], ["h", "c", "lang", "size", "phrase"])
                yield from slices([made], OUT_ROWS)

    return collect


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_column: str = "lang", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all phrases of 1 to ``longest`` words found ``least`` times, and ``lang, n`` of all words."""
    made = stage(shards(docs, longest, lang_column, text_column), "shards")
    pairs = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = stage(pairs.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least).select("lang", F.lit(1).alias("size"), "phrase", "f")
    maps: dict[int, np.ndarray] = {}
    counted = None
    for lengths in (range(2, 3), range(3, 4), range(4, longest + 1)):
        lengths = range(lengths.start, min(lengths.stop, longest + 1))
        if lengths:
            rows = _each_shard(made, maps, lengths.stop - 1, _digests(lengths), "h bigint, c bigint, n bigint, shard bigint")
            summed = rows.groupBy("h", "c").agg(F.sum("n").alias("f"), F.min("shard").alias("shard")).where(F.col("f") >= least)
            summed = stage(summed, "counts")
            maps |= dict.fromkeys(lengths, bit_map(summed))
            counted = summed if counted is None else counted.unionByName(summed)
    if counted is None:
        return frequent, total
    chosen = made.sparkSession.sparkContext.broadcast(bit_map(counted.select(F.col("h").bitwiseXOR(F.col("shard")).alias("h"))))
    texts = _each_shard(made, maps, longest, _texts(chosen), "h bigint, c bigint, lang string, size int, phrase string")
    texts = texts.groupBy("h", "c", "lang", "size", "phrase").agg(F.lit(1))
    longer = counted.join(texts, ["h", "c"]).select("lang", "size", "phrase", "f")
    return frequent.unionByName(stage(longer, "phrases")), total


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, scale: int = 1000,
    lang_column: str = "lang", text_column: str = "text",
) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates have 2 to ``longest`` words and occur ``a >= least`` times. Cut after k words into parts found
    l and r times, a candidate scores ``floor(scale * a * n / (l * r))`` at its lowest cut (ties: smallest k).
    One that lies inside a longer candidate with at least ``share`` percent of its count is dropped; as counts
    only fall with length, the candidates one word longer decide that. Phrases are summed by 128-bit digests;
    products are decimals of 38 digits. Null texts are empty, null languages ``und``; repeated rows count again; an
    empty table gives no rows; other columns are not read. Ties are settled by count and phrase. The ``top``
    rows per language are the report itself.
    """
    counted, total = phrase_counts(docs, least, longest, lang_column, text_column)
    candidates = counted.where("size > 1")
    parts = F.split("phrase", " ")
    joined = lambda start, length: F.array_join(F.slice(parts, start, length), " ")
    size = F.col("size")
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, size - F.col("k")).alias("right"))
    found = lambda name, text: counted.select("lang", F.col("phrase").alias(text), F.col("f").alias(name))
    cuts = cuts.join(found("l", "left"), ["lang", "left"]).join(found("r", "right"), ["lang", "right"]).join(total, "lang")
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} * cast(a AS decimal(16,0)) * cast(n AS decimal(16,0)) AS decimal(38,0)) div cast(cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)) AS decimal(38,0))"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ends = candidates.where("size > 2").select(
        "lang", "f", F.explode(F.array(joined(F.lit(1), size - 1), joined(F.lit(2), size - 1))).alias("phrase")
    )
    cover = ends.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(cover, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR 100 * most < {share} * a"))
    ranked = kept.selectExpr(
        "*", "row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank"
    ).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
