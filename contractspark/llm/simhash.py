"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

Two fingerprints within ``distance`` bits agree on at least one choice of all but ``distance`` of their
blocks of bits. Each fingerprint therefore goes once to every such choice, keyed by the bits of the chosen
blocks: these masked patterns are the top level of the index, where no difference is allowed, and they
are what Spark partitions by. Inside a cell the codes are sorted by Gray rank; groups of eight make nodes
that hold the bits all their codes share, and a search adds up differences from the top down and drops
whole groups once they exceed the distance. A cell gives a spanning forest of its links, not all pairs.

Cells of more than ``hot`` codes are linked without comparing codes: two codes are within 2r bits exactly
if some pattern is within r bits of both, so codes that reach the same pattern meet in a group, which can't
be larger than the number of patterns around one code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, text_or_empty

FANOUT = 8
#: Cells with more codes than this take the other way; both are exact.
HOT = 8192
#: Rows of cells that a task holds, and comparisons that it makes at a time.
CHUNK, AT_ONCE = 1 << 16, 1 << 21
_SHINGLES = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- fingerprints ------------------------------------------------------------------------------------
def fingerprint(text: str, shingle: int = 4) -> int:
    """A bit is set if it is set in over half of the XXH64 (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased; fewer words than a shingle make one shingle; no words give 0.
    """
    raw = text.encode().lower()  # bytes.lower changes A-Z only
    words = raw.split()  # at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    set_bits, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _SHINGLES], stops[at : at + _SHINGLES])], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int, text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed bigint. A null text has no words."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints.view(np.int64))], ["row", "fp"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp bigint")
    return made.select("row.*", "fp")


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the index within a cell ---------------------------------------------------------------------------
def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over runs of codes, each run sorted by Gray rank; ``runs`` holds the number of each code's run.

    Level 0 are the codes. A node above covers up to eight nodes of one run and holds which bits all codes
    below share; ``residual`` are those its parent doesn't have yet, so that a code's differences to a node
    are those to its parent plus the differing residual bits.
    """

    def __init__(self, codes: np.ndarray, runs: np.ndarray):
        full = np.full(len(codes), ~np.uint64(0))
        self.levels = [{"run": runs, "pattern": codes, "shared": full, "first": np.arange(len(codes)), "last": np.arange(len(codes))}]
        while len(self.levels[-1]["run"]) > len(np.unique(self.levels[-1]["run"])):
            below = self.levels[-1]
            run = below["run"]
            begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            place = np.arange(len(run)) - np.repeat(begins, np.diff(np.append(begins, len(run))))
            heads = np.flatnonzero(place % FANOUT == 0)
            sizes = np.diff(np.append(heads, len(run)))
            base = np.repeat(below["pattern"][heads], sizes)
            differ = np.bitwise_or.reduceat((below["pattern"] ^ base) | ~below["shared"], heads)
            self.levels.append({
                "run": run[heads], "pattern": below["pattern"][heads], "shared": ~differ, "child": heads, "sizes": sizes,
                "first": below["first"][heads], "last": below["last"][heads + sizes - 1],
            })
            below["residual"] = below["shared"] & ~np.repeat(~differ, sizes)
        self.levels[-1]["residual"] = self.levels[-1]["shared"]
        self.root_of = dict(zip(self.levels[-1]["run"].tolist(), range(len(self.levels[-1]["run"]))))

    def links(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of places in the index within the distance in the same run, other after query."""
        codes, top = self.levels[0]["pattern"], self.levels[-1]
        q = queries
        node = np.searchsorted(top["run"], self.levels[0]["run"][q])
        seen = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            seen = seen + np.bitwise_count((codes[q] ^ level["pattern"][node]) & level["residual"][node])
            stay = (seen <= distance) & (level["last"][node] > q)
            q, node, seen = q[stay], node[stay], seen[stay]
            if depth:
                sizes = level["sizes"][node]
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                node = np.repeat(level["child"][node], sizes) + within
                q, seen = np.repeat(q, sizes), np.repeat(seen, sizes)
        return q, node


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its class) after joining the classes of each a and b."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while (flat := labels[labels] != labels).any():
            labels[flat] = labels[labels[flat]]


def _forest(cells: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links within cells join; ``cells`` is sorted, a cell is one run."""
    runs = np.cumsum(np.concatenate([[0], cells[1:] != cells[:-1]]))
    sizes = np.bincount(runs)
    some = sizes[runs] > 1
    runs, codes = runs[some], codes[some]
    if not len(codes):
        return codes, codes
    order = np.lexsort((gray_rank(codes), runs))
    runs, codes = runs[order], codes[order]
    index, labels = GrayIndex(codes, runs), np.arange(len(codes))
    work = np.cumsum(sizes[runs])
    cuts = np.searchsorted(work, np.arange(AT_ONCE, work[-1] + AT_ONCE, AT_ONCE), side="left") + 1
    at = 0
    for cut in np.minimum(cuts, len(codes)).tolist():
        if cut > at:
            labels = _joined(labels, *index.links(np.arange(at, cut), distance))
            at = cut
    linked = labels != np.arange(len(codes))
    return codes[linked], codes[labels[linked]]


# ---- links between all fingerprints ----------------------------------------------------------------------
def masks(blocks: int, distance: int) -> list[int]:
    """The bits of every choice of ``blocks - distance`` of the blocks, as signed 64-bit numbers."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    chosen = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def n_blocks(codes: int, distance: int) -> int:
    """More blocks make finer cells and more copies of each code; a cell should hold a few dozen codes.

    The result is the same for any number; this only follows the size of the table.
    """
    return distance + (2 if codes < 1 << 26 else 3 if codes < 1 << 32 else 4)


def links(codes: DataFrame, distance: int, hot: int = HOT, blocks: int | None = None) -> DataFrame:
    """Edges ``u, v`` whose classes are those of the links between distinct fingerprints (column ``fp``)."""
    chosen = masks(blocks or n_blocks(codes.count(), distance), distance)
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(chosen))))
    cells = codes.select(cell.alias("at"), "fp").select("at.choice", "at.cell", "fp")
    large = stage(cells.groupBy("choice", "cell").count().where(F.col("count") > hot).select("choice", "cell"), "hot-cells")
    usual = cells.join(large, ["choice", "cell"], "left_anti")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(parts):
            choice, cell, fp = (np.concatenate(x) for x in zip(*parts))
            for c in np.unique(choice).tolist():
                own = choice == c
                u, v = _forest(cell[own], fp[own].view(np.uint64), distance)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            rows += batch.num_rows
            if rows >= CHUNK:  # the last cell may go on in the next batch
                choice, cell, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((choice == choice[-1]) & (cell == cell[-1]))[0])
                if cut:
                    yield from edges([(choice[:cut], cell[:cut], fp[:cut])])
                held, rows = [(choice[cut:], cell[cut:], fp[cut:])], len(fp) - cut
        if rows:
            yield from edges(held)

    found = usual.repartition("choice", "cell").sortWithinPartitions("choice", "cell").mapInArrow(search, "u bigint, v bigint")
    if large.isEmpty():
        return found

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every pattern within half the distance of each code, differing in bits outside the code's cell only."""
        flips = []
        for mask in chosen:
            free = [b for b in range(64) if not mask >> b & 1]
            near = [sum(1 << b for b in c) for r in range(distance - distance // 2 + 1) for c in combinations(free, r)]
            flips.append(np.array(near, np.uint64))
        for batch in slices(batches, 256):
            choice, fp = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for c in np.unique(choice).tolist():
                own = fp[choice == c]
                near = (own[:, None] ^ flips[c][None, :]).ravel()
                columns = [np.full(len(near), c, np.int32), near.view(np.int64), np.repeat(own, len(flips[c])).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["choice", "near", "fp"])

    dense = cells.join(large, ["choice", "cell"], "left_semi").mapInArrow(around, "choice int, near bigint, fp bigint")
    met = dense.groupBy("choice", "near").agg(F.collect_set("fp").alias("codes")).where(F.size("codes") > 1)
    stars = met.select(F.explode("codes").alias("u"), F.array_min("codes").alias("v")).where("u != v").distinct()
    return found.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """``u, label`` for every node with an edge: the smallest node of its class, by alternating star contraction.

    Each round is a written table. The rounds end when the edges no longer change; their number grows with
    the logarithm of the longest chain.
    """
    forward = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    current, before = stage(forward(edges), "edges"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        rows = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        current = stage(rows.where("u != v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select("u", F.col("v").alias("label"))
        before = state


def classes(prints: DataFrame, distance: int, hot: int = HOT, blocks: int | None = None) -> DataFrame:
    """Adds ``component_id`` (smallest id reachable) and ``is_first`` (one row per class: smallest id, then key).

    ``prints`` is a staged table ``key, id, fp``; keys are distinct. Exact copies share a fingerprint and so
    meet before any linking. Ids may be null or repeat: null ids come last, a class without any has a null
    component_id.
    """
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("key").alias("key"))
    codes = stage(prints.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    labels = components(links(codes.select("fp"), distance, hot, blocks))
    rooted = codes.join(labels.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    by_code = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    joined = prints.join(by_code, "fp")
    return joined.select(
        "key", "id", "fp", F.col("first.id").alias("component_id"), (F.col("first.key") == F.col("key")).alias("is_first")
    )


def near_duplicates(
    docs: DataFrame, shingle: int, distance: int, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT
) -> DataFrame:
    """``key, id, fp, component_id, is_first`` of every row; see ``classes``. Null and empty texts have fingerprint 0.

    Repeated rows stay; an empty table gives none; other columns aren't read.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return classes(stage(with_fingerprints(keyed, ["key", "id"], shingle), "prints"), distance, hot)


def drop_near_duplicates(
    docs: DataFrame, shingle: int, distance: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each class, with the columns it came with.

    The rows are written once with a key, so that keys and rows agree whatever happens to executors.
    """
    columns = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("key"), columns), "documents")
    slim = keyed.select("key", F.col(f"row.`{id_column}`").alias("id"), F.col(f"row.`{text_column}`").alias("text"))
    prints = stage(with_fingerprints(slim, ["key", "id"], shingle), "prints")
    first = classes(prints, distance).where("is_first").select("key")
    return keyed.join(first, "key", "left_semi").select("row.*")
