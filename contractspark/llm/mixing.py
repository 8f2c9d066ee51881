"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target, and so each of its documents a fractional number of copies. The whole part is
taken; the fraction is an inclusion probability. The flight moves the probabilities of three documents at a
time along the null-space of the two balancing equations (words and documents) until one is 0 or 1, so both
totals of a block stay exact. Blocks of a source fly by themselves; what they leave, two documents at most
each, flies again in larger blocks. The last of them land with a few hundred documents of the source that
waited, so that small ones can take up the rounding of large ones.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, text_or_empty

#: Documents in a block of the first flight, and blocks whose leftovers meet in the next.
BLOCK, MERGE = 2048, 512
#: Documents of a source, about, that wait for the landing.
WAITING = 256
_EDGE = 1e-9
WEIGHTS = (1.0, 2.0, 3.0)


# ---- targets -------------------------------------------------------------------------------------------
def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source, source_size, n``).

    Sources by code point, null last, take the weights in turn and share all words by weight; none gets
    more than ``most`` times its size, and the excess is shared by the others. With sources sorted by the
    share at which they fill up, the level of sharing follows from sums over those before. The table has
    one row per source and is ordered in one task.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    limit, everyone = most * F.col("source_size"), Window.partitionBy()
    by_level = Window.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumns({"full": limit / F.col("weight"), "limit": limit})
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    shares = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = filled.withColumns({"level": left / shares, "place": F.row_number().over(by_level)})
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("place", "level"))).over(everyone)["level"]
    return levelled.withColumn("target", F.least(F.col("weight") * F.coalesce(level, F.lit(0.0)), "limit")).select("source", "source_size", "n", "target")


# ---- the cube method ------------------------------------------------------------------------------------
def _moved(p: list[float], units: list[int], u: list[float], rng: random.Random) -> None:
    """One random step along +-u to the first wall in that direction; keeps each expectation."""
    up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(units, u) if v)
    down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(units, u) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in zip(units, u):
        q = p[i] + step * v
        p[i] = 0.0 if q < _EDGE else 1.0 if q > 1 - _EDGE else q


def flight(p: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight; at most two are left between 0 and 1."""
    p, units = list(p), []
    for i in range(len(p)):
        if 0 < p[i] < 1:
            units.append(i)
        while len(units) == 3:
            a, b, c = (sizes[t] for t in units)
            u = [b - c, c - a, a - b]
            scale = max(map(abs, u))
            _moved(p, units, [x / scale for x in u] if scale else [1.0, -1.0, 0.0], rng)
            units = [t for t in units if 0 < p[t] < 1]
    return p


def landing(p: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Every probability becomes 0 or 1, largest document first; gives up the balance of documents.

    What rounding one document adds in words is taken from the next smaller ones in equal measure, up or
    down, so expectations stay and the last error is that of a small document. Only where the smaller ones
    can't take up one rounding but can the other, the other is chosen.
    """
    p = list(p)
    order = sorted((i for i in range(len(p)) if 0 < p[i] < 1), key=lambda i: -sizes[i])
    for k, i in enumerate(order):
        if not 0 < p[i] < 1:
            continue
        goal = 1.0 if rng.random() < p[i] else 0.0
        down = sum(p[j] * sizes[j] for j in order[k + 1 :] if p[j] < 1)
        up = sum((1 - p[j]) * sizes[j] for j in order[k + 1 :] if p[j] < 1)
        fits = {1.0: (1 - p[i]) * sizes[i] <= down, 0.0: p[i] * sizes[i] <= up}
        if not fits[goal] and fits[1 - goal]:
            goal = 1 - goal
        words, p[i] = (goal - p[i]) * sizes[i], goal
        for j in order[k + 1 :]:
            if abs(words) < _EDGE or not sizes[j]:
                break
            if 0 < p[j] < 1:
                q = min(1.0, max(0.0, p[j] - words / sizes[j]))
                words -= (p[j] - q) * sizes[j]
                p[j] = 0.0 if q < _EDGE else 1.0 if q > 1 - _EDGE else q
    return p


def flown_and_landed(p: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """The larger half flies; what it leaves lands together with the smaller half, which takes up the rounding."""
    order = sorted(range(len(p)), key=lambda i: -sizes[i])
    half = order[: len(order) // 2]
    after = list(p)
    for i, q in zip(half, flight([p[i] for i in half], [sizes[i] for i in half], rng)):
        after[i] = q
    return landing(after, sizes, rng)


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Adds ``source_size, target, copies`` to the rows of a staged table ``key, id, source, size, h``.

    ``h`` spreads a source's rows over blocks, whatever their number: a hot source has more blocks, not
    larger ones. Rows with equal id and text fall into one block. All draws come from the seed and the
    block, and rows are taken in the order of size, h, id, so reruns agree. Sources without words, and
    rows of size 0 like others, are taken no more than ``most`` times.
    """
    totals = rows.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"), F.count("*").alias("n"))
    aims = stage(targets(totals, weights, most), "targets")
    blocks = F.ceil(F.col("n") / BLOCK)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = rows.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "key", "id", "source", "size", "h", "source_size", "target", F.floor(ratio + _EDGE).alias("copies"),
        F.greatest(ratio - F.floor(ratio + _EDGE), F.lit(0.0)).alias("p"), F.pmod("h", blocks).alias("block"),
        (F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / WAITING)) == 0).alias("waits"),
    )
    schema = planned.schema

    def run(function, level: int):
        def fly(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["size", "h", "id"], kind="stable", na_position="last")
            first = block.iloc[0]
            rng = random.Random(f"{seed}:{level}:{first['source']}:{first['block']}")
            return block.assign(p=function(block["p"].tolist(), block["size"].astype(float).tolist(), rng))

        return fly

    open_ = (F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)
    settled, moving = planned.where(~open_), planned.where(open_)
    waiting = moving.where("waits").withColumn("block", F.lit(0).cast("bigint"))
    flying, left, level = moving.where("NOT waits"), int(aims.agg(F.max(blocks)).first()[0] or 1), 0
    while True:
        flown = stage(flying.groupBy("source", "block").applyInPandas(run(flight, level), schema), "flight")
        settled = settled.unionByName(flown.where(~open_))
        flying = flown.where(open_).withColumn("block", F.floor(F.col("block") / MERGE))
        left, level = -(-left // MERGE), level + 1
        if left == 1:
            break
    landed = flying.unionByName(waiting).groupBy("source").applyInPandas(run(flown_and_landed, level), schema)
    return settled.unionByName(landed).withColumn("copies", F.col("copies") + F.round("p").cast("bigint")).drop("p", "block", "h", "waits")


def sized(docs: DataFrame, key, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 7) -> DataFrame:
    """The table that ``mix`` takes; a document's size is its number of words, 0 for null."""
    text = text_or_empty(text_column)
    return docs.select(
        key.alias("key"), F.col(id_column).alias("id"), F.col(source_column).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(F.lit(seed), F.col(id_column), text).alias("h"),
    )


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents in the mix, each as often as it is taken, with the columns they came with.

    The rows are written once with a key; the decisions are made on a slim table and joined back.
    """
    columns = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("key"), columns), "documents")
    slim = sized(keyed, F.col("key"), f"row.`{id_column}`", f"row.`{text_column}`", f"row.`{source_column}`")
    taken = mix(stage(slim, "sizes")).where("copies > 0").select("key", "copies")
    repeated = keyed.join(taken, "key").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("row.*")
