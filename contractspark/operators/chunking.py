"""Greedy token-budget chunking of ordered pages.

A page closes the open chunk when adding it would exceed the budget; an oversize page is a chunk of its
own. Documents that fit one block of pages are folded by Spark in one group per document. Longer
documents (a single one may hold a large share of all pages) are cut into blocks by page number: what
a block does to the open chunk is a function of its token count, a finite table, so the tables are
computed block by block in parallel, chained to get each block's starting state, and only then are the
pages assigned, again block by block. Both ways give the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.tokens import TokenCounter, regex_token_count
from ..rules import PAGE_TOKEN_BUDGET
from .paging import BLOCK_PAGES, page_block, split_by_depth

PAGE_BREAK = "\n\n"
FAN_IN = 512  # blocks (or groups of blocks) chained in one task
OUT_ROWS = 1024  # rows (a block's pages at least) that a task returns at a time


def chunk_pages(
    pages: DataFrame, budget: int = PAGE_TOKEN_BUDGET, counter: TokenCounter = regex_token_count,
    block_pages: int = BLOCK_PAGES, fan_in: int = FAN_IN,
) -> DataFrame:
    """``doc_id, chunk_no`` (from 1), ``chunk_text`` for pages ``doc_id, page_no, text``.

    Pages without a number come first; pages of one number are ordered by tokens and then text. Runs one
    small job to see whether there are documents beyond one block.
    """
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(PAGE_BREAK))
    short, deep = split_by_depth(pages, block_pages)
    chunks = _fold_documents(short.select("doc_id", "page_no", body.alias("body")), budget, counter)
    if deep is None:
        return chunks
    measured = deep.pages.select(
        "doc_id", page_block(block_pages, deep.first_block).alias("block"), "page_no", body.alias("body")
    ).withColumn("tokens", counter(F.col("body")))
    blocks = (deep.first_block, deep.last_block)
    return chunks.unionByName(_chunk_blocks(measured, budget, blocks, max(fan_in, 2)))


# ---- documents of one block ------------------------------------------------------------------------
def _fold_documents(pages: DataFrame, budget: int, counter: TokenCounter) -> DataFrame:
    grouped = (
        pages.withColumn("tokens", counter(F.col("body")))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "tokens", "body"))).alias("pages"))
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("open"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("starts")
    )

    def step(acc: Column, page: Column) -> Column:
        opens = (acc["seen"] == 0) | (acc["open"] + page["tokens"] > budget)
        return F.struct(
            F.when(opens, page["tokens"]).otherwise(acc["open"] + page["tokens"]).alias("open"),
            (acc["seen"] + 1).alias("seen"),
            F.when(opens, F.array_append(acc["starts"], acc["seen"] + 1)).otherwise(acc["starts"]).alias("starts"),
        )

    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("pages") + 1))
    texts = F.zip_with(
        "starts", ends,
        lambda a, b: strip(F.array_join(F.transform(F.slice("pages", a, b - a), lambda p: p["body"]), "")),
    )
    whole = F.when(F.element_at("texts", -1) == "", F.slice("texts", 1, F.size("texts") - 1)).otherwise(F.col("texts"))
    return (
        grouped.withColumn("starts", F.aggregate("pages", start, step)["starts"])
        .withColumn("texts", texts)
        .select("doc_id", F.posexplode(whole).alias("chunk_no", "chunk_text"))
        .withColumn("chunk_no", F.col("chunk_no").cast("bigint") + 1)
    )


# ---- documents of many blocks ----------------------------------------------------------------------
# State of the open chunk: its token count 0..budget, budget+1 for "over budget" (one oversize page),
# budget+2 for "no page yet". A block maps each possible state at its first page to the state after its
# last page and to the number of chunks it closes on the way.
def _advance(state: np.ndarray, tokens: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    over, empty = budget + 1, budget + 2
    fresh = state == empty
    closes = ~fresh & (state + tokens > budget)
    after = np.where(fresh | closes, min(tokens, over), state + tokens)
    return after, closes


def _per_group(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[pa.Table], list], schema: str, types: pa.Schema) -> DataFrame:
    """``each`` group's rows, in order, made into columns of new rows.

    A task walks through its sorted rows: blocks may be very many and short, and a Python call with a frame
    of its own for each would cost far more than the work.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[] for _ in types]
        for group in _groups(batches, keys):
            for column, values in zip(made, each(group)):
                column.extend(values)
            if len(made[0]) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, types)], schema=types)
                made = [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, types)], schema=types)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which may go on from batch to batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        if held and (key[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], None]):
            held.append(batch.slice(start) if end is None else batch.slice(start, end - start))
            if end is not None:
                yield pa.Table.from_batches(held)
                held = []
        last = key[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _block_table(group: pa.Table, budget: int) -> list:
    state = np.arange(budget + 3)
    closed = np.zeros(budget + 3, dtype=np.int64)
    for tokens in group["tokens"].to_pylist():
        state, closes = _advance(state, tokens, budget)
        closed += closes
    return [[group["doc_id"][0].as_py()], [group["block"][0].as_py()], [state], [closed]]


def _tables(group: pa.Table, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tables of a group's blocks; a row with the entry has none."""
    flat = (np.concatenate([c.flatten().to_numpy() for c in group[name].chunks]) for name in ("state", "closed"))
    return zip(*(f.reshape(-1, budget + 3) for f in flat))


def _join_tables(group: pa.Table, budget: int) -> list:
    """The tables of consecutive blocks as one table of the blocks' parent."""
    state, closed = np.arange(budget + 3), np.zeros(budget + 3, dtype=np.int64)
    for after, closes in _tables(group, budget):
        closed = closed + closes[state]
        state = after[state]
    return [[group["doc_id"][0].as_py()], [group["parent"][0].as_py()], [state], [closed]]


def _walk(group: pa.Table, budget: int) -> list:
    """Entry state and number of chunks closed so far for each block of one group; its own entry may come first."""
    state, closed = group["entry_state"][0].as_py(), group["entry_closed"][0].as_py()
    blocks = group["block"].to_pylist()
    if state is None:
        state, closed = budget + 2, 0
    else:
        blocks = blocks[1:]
    states, counts = [], []
    for after, closes in _tables(group, budget):
        states.append(state)
        counts.append(closed)
        closed += int(closes[state])
        state = int(after[state])
    return [[group["doc_id"][0].as_py()] * len(blocks), blocks, states, counts]


_TABLE = "doc_id bigint, block bigint, state array<int>, closed array<bigint>"
_TABLE_TYPES = pa.schema({"doc_id": pa.int64(), "block": pa.int64(), "state": pa.list_(pa.int32()), "closed": pa.list_(pa.int64())})
_ENTRY = "doc_id bigint, block bigint, entry_state int, entry_closed bigint"
_ENTRY_TYPES = pa.schema({"doc_id": pa.int64(), "block": pa.int64(), "entry_state": pa.int32(), "entry_closed": pa.int64()})
_CHUNK = "doc_id bigint, page_no bigint, tokens bigint, body string, chunk_no bigint"
_CHUNK_TYPES = pa.schema({"doc_id": pa.int64(), "page_no": pa.int64(), "tokens": pa.int64(), "body": pa.string(), "chunk_no": pa.int64()})


def _with_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows and, as rows of their own, the entries of their groups, which ``_entry_last`` puts first."""
    return rows.unionByName(entries, allowMissingColumns=True).withColumn("_entry_last", F.col("entry_state").isNull())


def _block_entries(tables: DataFrame, budget: int, blocks: tuple[int, int], fan_in: int) -> DataFrame:
    """``doc_id, block, entry_state, entry_closed`` by chaining tables in groups of ``fan_in``.

    ``blocks`` is the range of block numbers; each level divides it by ``fan_in``.
    """
    def walk(group: pa.Table) -> list:
        return _walk(group, budget)

    low, high = blocks
    if high - low < fan_in:
        first = tables.withColumn("entry_state", F.lit(None).cast("int")).withColumn("entry_closed", F.lit(None).cast("bigint"))
        return _per_group(first, ["doc_id"], ["block"], walk, _ENTRY, _ENTRY_TYPES)
    grouped = tables.withColumn("parent", F.floor(F.col("block") / fan_in))
    parents = _per_group(grouped, ["doc_id", "parent"], ["block"], lambda group: _join_tables(group, budget), _TABLE, _TABLE_TYPES)
    upper = _block_entries(parents, budget, (low // fan_in, high // fan_in), fan_in)
    both = _with_entries(grouped, upper.withColumnRenamed("block", "parent"))
    return _per_group(both, ["doc_id", "parent"], ["_entry_last", "block"], walk, _ENTRY, _ENTRY_TYPES)


def _assign(group: pa.Table, budget: int) -> list:
    """Chunk numbers of a block's pages; its entry comes first."""
    state, chunk = group["entry_state"][0].as_py(), group["entry_closed"][0].as_py() + 1
    pages = group.slice(1)
    tokens, numbers = pages["tokens"].to_pylist(), []
    for n in tokens:
        fresh = state == budget + 2
        closes = not fresh and state + n > budget
        state = min(n, budget + 1) if fresh or closes else state + n
        chunk += closes
        numbers.append(chunk)
    return [*(pages[c].to_pylist() for c in ("doc_id", "page_no")), tokens, pages["body"].to_pylist(), numbers]


def _chunk_blocks(pages: DataFrame, budget: int, blocks: tuple[int, int], fan_in: int) -> DataFrame:
    pages = pages.select(F.col("doc_id").cast("bigint"), F.col("block").cast("bigint"), F.col("page_no").cast("bigint"), F.col("tokens").cast("bigint"), "body")
    narrow = pages.drop("body")
    block = ["doc_id", "block"]
    tables = _per_group(narrow, block, ["page_no", "tokens"], lambda group: _block_table(group, budget), _TABLE, _TABLE_TYPES)
    last_pages = narrow.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    both = _with_entries(pages, _block_entries(tables, budget, blocks, fan_in))
    order = ["_entry_last", "page_no", "tokens", "body"]
    assigned = _per_group(both, block, order, lambda group: _assign(group, budget), _CHUNK, _CHUNK_TYPES)
    text = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "tokens", "body"))), lambda p: p["body"])
    return (
        assigned.groupBy("doc_id", "chunk_no")
        .agg(strip(F.array_join(text, "")).alias("chunk_text"), F.max("page_no").alias("_page"))
        .join(last_pages, "doc_id")
        .where((F.col("chunk_text") != "") | ~F.coalesce(F.col("_page") == F.col("last_page"), F.lit(False)))
        .drop("_page", "last_page")
    )
