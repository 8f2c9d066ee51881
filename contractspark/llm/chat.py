"""Chat formatting in budgeted windows with a loss mask.

Prefix sums of turn tokens lay a conversation out on a line that is cut into spans of equal length; the turns
that start in a span make a window, so windows are turn-aligned and none depends on the one before. Each
window keeps the conversation's first system turn and repeats the last turns before it up to a limit; both
are masked, so that each assistant text counts once. Prefix sums are made within blocks of turns and then
over the blocks, so a long conversation is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

HEAD, MIDDLE, END = "### ", ":\n", "</turn>\n"
#: Turns in a block of the prefix sums.
BLOCK = 256
#: Tokens that a turn's marks count for.
MARKS = 4
LOSS_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: Column) -> Column:
    """After this a text holds neither the end mark nor three number signs; ``unescape`` undoes it.

    Backslashes are doubled, and one is put inside each control string.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=##)", r"#\\"), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Also free of colons, so that the first one ends the role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\;", "$1:"))


def turn_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint") + MARKS


def _placed(turns: DataFrame) -> DataFrame:
    """Adds ``start``, the tokens before each turn in its conversation. Order: turn (null last), role, text."""
    block = F.floor(F.coalesce("turn", F.lit((1 << 62) - 1)) / BLOCK)
    rows = turns.withColumn("block", block)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("own"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    joined = local.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select("conv_id", "role", "text", "tokens", (F.col("offset") + F.col("local")).alias("start"))


def _segment(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), escape_role(turn["role"]), F.lit(MIDDLE), escape(turn["text"]), F.lit(END))


def _loss_spans(context: Column, targets: Column) -> Column:
    """Start and end, in the formatted text, of each assistant text among the targets."""
    length = lambda t: F.char_length(_segment(t))
    kind = "array<struct<start:int,end:int>>"
    skipped = F.aggregate(context, F.lit(0), lambda n, t: n + length(t))

    def step(seen, t):
        start = seen["at"] + F.char_length(F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(MIDDLE)))
        own = F.array(F.struct(start.alias("start"), (start + F.char_length(escape(t["text"]))).alias("end")))
        spans = F.when(t["role"] == LOSS_ROLE, F.concat(seen["spans"], own)).otherwise(seen["spans"])
        return F.struct((seen["at"] + length(t)).alias("at"), spans.cast(kind).alias("spans"))

    return F.aggregate(targets, F.struct(skipped.alias("at"), F.array().cast(kind).alias("spans")), step)["spans"]


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, window, formatted, n_context, loss_spans, n_tokens`` from rows ``conv_id, turn, role, text``.

    The first ``n_context`` turns of a window are masked context. Targets of a window take at most
    ``budget - history`` tokens, except a turn longer than half of that, which has a window of its own; the
    system turn comes on top. Null roles and texts are empty; rows of a null conv_id are one conversation;
    repeated rows are repeated turns.
    """
    span = max(1, (budget - history) // 2)
    limit = min(history, span)
    plain = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    placed = _placed(plain).withColumn("slot", F.floor(F.col("start") / span))
    # a turn near the end of its span is also history of the next
    ends_near = (F.col("slot") + 1) * span - F.col("start") <= limit
    slots = F.explode(F.when(ends_near, F.array("slot", F.col("slot") + 1)).otherwise(F.array("slot"))).alias("at")
    turn = F.struct("start", "tokens", "role", "text", F.lit(True).alias("own"))
    copies = placed.select("conv_id", "slot", slots, turn.alias("t"))
    owned = F.struct(*(F.col(f"t.{c}").alias(c) for c in ("start", "tokens", "role", "text")), (F.col("at") == F.col("slot")).alias("own"))
    gathered = copies.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(owned)).alias("turns"))  # a span's tokens bound it
    long = lambda t: t["own"] & (t["tokens"] > span)
    parts = gathered.select(
        "conv_id", "at", "turns", F.filter("turns", lambda t: t["own"] & (t["tokens"] <= span)).alias("short"), F.filter("turns", long).alias("long")
    )

    def window(number: int, targets: str) -> Column:
        first = F.get(targets, F.lit(0))["start"]
        before = F.filter("turns", lambda t: (t["start"] < first) & (t["start"] >= first - limit))
        made = F.struct((F.col("at") * 2 + number).alias("window"), before.alias("history"), F.col(targets).alias("targets"))
        return F.when(F.size(targets) > 0, made)

    both = F.explode(F.array_compact(F.array(window(0, "short"), window(1, "long")))).alias("w")
    windows = parts.select("conv_id", both).select("conv_id", "w.window", "w.history", "w.targets")
    system = placed.where(F.col("role") == SYSTEM_ROLE).groupBy(F.col("conv_id").alias("c")).agg(
        F.min(F.struct("start", "tokens", "role", "text", F.lit(False).alias("own"))).alias("system")
    )
    joined = windows.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    first = F.coalesce(F.get("history", F.lit(0))["start"], F.get("targets", F.lit(0))["start"])
    context = F.when(F.col("system.start") < first, F.concat(F.array("system"), "history")).otherwise(F.col("history"))
    shaped = joined.select("conv_id", "window", context.alias("context"), "targets")
    everything = F.concat("context", "targets")
    return shaped.select(
        "conv_id", "window", F.array_join(F.transform(everything, _segment), "").alias("formatted"), F.size("context").alias("n_context"),
        _loss_spans(F.col("context"), F.col("targets")).alias("loss_spans"),
        F.aggregate(everything, F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns`` (role and text of the targets) ``, loss`` from formatted windows alone."""
    pieces = F.split("formatted", END)
    own = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_context"), F.lit(0)))
    cut = windows.select("conv_id", "window", "formatted", "loss_spans", own.alias("own"))

    def parsed(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        text = F.substring(piece, at + len(MIDDLE), F.char_length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return cut.select("conv_id", "window", F.transform("own", parsed).alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("formatted").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation from ``read_back``: numbers and SHA-256 over its windows in order.

    A digest needs a conversation's text in order, so its windows are sorted in one task and streamed
    through it; the task holds one window at a time.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "window", F.size("turns").cast("bigint").alias("n"), said.alias("said"), "loss", F.col("chars").cast("bigint").alias("chars"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[list]) -> pa.RecordBatch:
            done = [[c, n, turns.hexdigest(), k, loss.hexdigest(), chars] for c, n, turns, k, loss, chars in rows]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)

        now: list | None = None
        for batch in batches:
            ready = []
            for conv, _, n, said_, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is None or now[0] != conv:
                    if now is not None:
                        ready.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += n
                now[2].update(said_.encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if ready:
                yield made(ready)
        if now is not None:
            yield made([now])

    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
