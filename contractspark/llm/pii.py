"""Personal data: strict patterns, and beyond them candidates that boosted trees judge by format and context.

Strict spans always stay. High-recall generators propose further, overlapping spans (a phone number without a
plus, digits grouped by other marks, addresses written around the at sign). The trees learn from the corpus
itself: strict spans and rewritten forms of them are positive, damaged forms and the other candidates of the
same texts that fail their kind's check are negative. Features leave out the very mark that the strict
pattern demands, so what is learned carries over to the other forms. Every text of the corpus is learned from:
Spark counts the labelled rows, and the trees, their bins and the thresholds come from sums over all of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .common import slices, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Up to so many distinct binned rows are added up in the driver, more of them by a Spark job per level of each tree.
LOCAL_ROWS = 50_000
#: Probabilities are cut down to multiples of one over this, so that thresholds come from bounded counts.
STEPS = 10_000
#: Held-out precision that a kind's threshold must reach, and the least threshold.
PRECISION, LEAST = 0.99, 0.9


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    score: float = 1.0
    base: bool = True


# ---- strict patterns ---------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# no match can begin behind a digit: a match or a failing run of digits always takes the whole run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each at sign, the run of local characters before it (not into the last match)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def _octets(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def strict_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    found = []
    if "@" in text:
        found += [Span(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [Span(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(Span(2, m.start(), m.end()))
    if "+" in text:
        found += [Span(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s.start, s.kind, s.end))


# ---- candidates ----------------------------------------------------------------------------------------
_ADDRESS = re.compile(
    r"[\w.%+-]{1,64}\s?(?:@|[\[({]\s?at\s?[\])}])\s?[\w-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[\w-]{1,63}){1,6}", re.I
)
_NUMBERS = (
    (1, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{4}){2}[ ._/-]{0,2}[0-9]{1,7}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")),
)
#: Where an address may be; its generator looks around these places only.
_AT = re.compile(r"@|[\[({]\s?[aA][tT]\s?[\])}]")
_BEFORE_AT, _AFTER_AT = 66, 420
_CONTEXT = 40
#: Words near a candidate that speak for each kind, and against any.
_HINTS = (
    re.compile(r"\b(e-?mail|mail|contact|write|send|correo|courriel|kontakt)", re.I),
    re.compile(r"\b(ip|host|server|addr|address|client|gateway|ping)\b", re.I),
    re.compile(r"\b(card|visa|master|credit|debit|amex|payment|karte|carte|tarjeta)", re.I),
    re.compile(r"\b(tel|phone|call|mobile|cell|fax|whatsapp|sms|telefon|tel[eé]fono|t[eé]l[eé]phone)", re.I),
)
_AGAINST = re.compile(r"\b(version|ver|release|order|invoice|isbn|sku|serial|section|chapter|page|item|no|nr|id|date|token|key|hash|password|secret)\b\W{0,4}$", re.I)
FEATURES = 24


def features(kind: int, text: str, start: int, end: int) -> list[float]:
    """Format of the span and of its surroundings; the leading plus of a phone number is left out."""
    span = text[start:end].lstrip("+")
    digits = _digits(span)
    groups = [g for g in _NOT_DIGIT.split(span) if g]
    lengths = [len(g) for g in groups]
    before, after = text[max(0, start - _CONTEXT) : start], text[end : end + _CONTEXT]
    near = before[-1:], after[:1]
    context = before + " " + after
    letters = sum(c.isalpha() for c in span)
    tail = span.rpartition(".")[2]
    return [
        *(float(kind == k) for k in range(4)),
        len(digits), len(groups), max(lengths, default=0), min(lengths, default=0),
        letters, len(span), len(span) - letters - len(digits),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(len(digits) > 0 and len(set(digits)) <= 2), float(digits[:1] in ("3", "4", "5", "6")),
        float(2 <= len(tail) <= 12 and tail.isalpha() and tail.isascii()), float("(" in span),
        float(near[0] in ("", " ", "\n", "\t", ":", "(", ",", ";", "<")), float(near[1] in ("", " ", "\n", "\t", ",", ".", ";", ")", ">", "!", "?")),
        float(near[0].isalnum() or near[1].isalnum()), float(bool(_HINTS[kind].search(context))),
        float(any(_HINTS[k].search(context) for k in range(4) if k != kind)), float(bool(_AGAINST.search(before))),
        float(re.match(r"(19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}$", span) is not None),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """All spans that a generator proposes; they may overlap each other and strict spans."""
    found = []
    for at in _AT.finditer(text):
        m = _ADDRESS.search(text, max(0, at.start() - _BEFORE_AT), at.end() + _AFTER_AT)
        if m and m.start() < at.start() < m.end():
            found.append((0, m.start(), m.end()))
    if _DIGIT.search(text):
        for kind, pattern in _NUMBERS:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if 7 <= len(_digits(m[0])) <= 19]
    return found


def _rewritten(kind: int, s: str) -> list[str]:
    """Other ways of writing a strict span."""
    digits = _digits(s)
    if kind == 0:
        local, _, domain = s.partition("@")
        return [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain}"]
    if kind == 1:
        return [s.replace(".", "[.]")]
    if kind == 2:
        return [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in (".", "/", " ")]
    local = digits[-10:]
    return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{digits[:-10]} {local[:3]} {local[3:]}"] if len(local) == 10 else []


def _damaged(kind: int, s: str) -> list[str]:
    """Forms that no longer are what they look like."""
    digits = _digits(s)
    if kind == 0:
        return [s.replace("@", " (at) ").split(".")[0] + ".1", s.rpartition(".")[0] + ".9"]
    if kind == 1:
        return [".".join(str(int(p.lstrip("0") or 0) + 256) for p in s.split(".")), s + ".7"]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), wrong]
    return [f"20{digits[-2:]}-{digits[-4:-2]}-{digits[-6:-4]}", "-".join(digits), f"{digits[:2]} {digits[2:4]} {digits[4:7]}", f"{digits[:4]}-{digits[4:8]}-{digits[-4:]}", f"{digits[-4:]} {digits[:2]} {digits[2:5]} {digits[5:8]}"]


class _Taken:
    """Intervals of a text that further spans must not overlap, sorted and disjoint."""

    def __init__(self, spans: Iterable[Span]):
        self.starts, self.ends = [], []
        for s in spans:  # by start
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start), self.ends.append(s.end)

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before == 0 or self.ends[before - 1] <= start

    def take(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start), self.ends.insert(at, end)


def labelled(text: str) -> Iterator[tuple[int, float, list[float]]]:
    """kind, label and features of a text's candidates and of rewritten and damaged strict spans."""
    strict = strict_spans(text)
    for s in strict:
        yield s.kind, 1.0, features(s.kind, text, s.start, s.end)
        own, before, after = text[s.start : s.end], text[max(0, s.start - _CONTEXT) : s.start], text[s.end : s.end + _CONTEXT]
        for label, forms in ((1.0, _rewritten(s.kind, own)), (0.0, _damaged(s.kind, own))):
            for form in forms:
                yield s.kind, label, features(s.kind, before + form + after, len(before), len(before) + len(form))
    taken = _Taken(strict)
    for kind, a, b in candidates(text):
        if taken.free(a, b) and not _plausible(kind, text[a:b]):
            yield kind, 0.0, features(kind, text, a, b)


def _plausible(kind: int, s: str) -> bool:
    """Whether a candidate could be its kind in another form; such ones are neither positive nor negative."""
    digits = _digits(s)
    if kind == 0:
        return True
    if kind == 1:
        return all(int(p) <= 255 for p in _NOT_DIGIT.split(s) if p)
    return luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


# ---- model -----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> list[Span]:
        """Strict spans and the further ones that the trees select, best first where those overlap."""
        strict = strict_spans(text)
        taken = _Taken(strict)
        proposed = [(k, a, b) for k, a, b in candidates(text) if taken.free(a, b) and _plausible(k, text[a:b])]
        if not proposed:
            return strict
        scores = _stepped(self.trees.probability(np.array([features(k, text, a, b) for k, a, b in proposed])))
        chosen: list[Span] = []
        for i in np.argsort(-scores, kind="stable").tolist():
            kind, a, b = proposed[i]
            if scores[i] >= self.thresholds[kind] and taken.free(a, b):
                taken.take(a, b)
                chosen.append(Span(kind, a, b, float(scores[i]), False))
        return sorted(strict + chosen, key=lambda s: (s.start, s.kind, s.end))


def _stepped(probability: np.ndarray) -> np.ndarray:
    return np.floor(probability * STEPS) / STEPS


def labelled_rows(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``held, kind, label, x`` and ``n``, how often: the labelled rows of every distinct text, by what they hold.

    Texts are told by their 64-bit hash, which also decides whether a text is held out (a fifth of them). Texts
    without a digit and an at sign have no labelled rows. What a text holds is counted where it lies; only
    the counts are shuffled.
    """
    some = docs.select(F.col(text_column).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Counter(
                (h, k, y, tuple(map(int, x)))
                for h, text in dict(zip(batch.column("h").to_pylist(), batch.column("text").to_pylist())).items() for k, y, x in labelled(text)
            )
            h, kind, label, values = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(kind, pa.int32()), pa.array(label, pa.float64()), pa.array(values, pa.list_(pa.int32())), pa.array(found.values(), pa.int64())],
                ["h", "kind", "label", "x", "n"],
            )

    made = some.select(F.xxhash64("text").alias("h"), "text").mapInArrow(make, "h bigint, kind int, label double, x array<int>, n bigint")
    by_text = made.groupBy("h", "kind", "label", "x").agg(F.max("n").alias("n"))
    held = (F.pmod("h", F.lit(5)) == 0).alias("held")
    return by_text.groupBy(held, "kind", "label", "x").agg(F.sum("n").alias("n"))


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Per feature, up to ``BINS - 1`` distinct quantiles of the training rows."""
    values = rows.where("not held").select("n", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("feature")
    upto = F.sum("n").over(of.orderBy("value"))
    ranked = values.withColumns({"upto": upto, "all": F.sum("n").over(of)})
    bins = boosting.BINS
    passes = F.expr(f"least({bins - 1}, {bins} * upto div all) > {bins} * (upto - n) div all")
    found = ranked.where(passes).select("feature", "value").collect()
    return [np.array(sorted(r.value for r in found if r.feature == j), np.float64) for j in range(FEATURES)]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The rows with their bins, a byte each, in place of the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
            bins = [r.tobytes() for r in boosting.binned(x, cuts).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("held", "kind", "label", "n")), pa.array(bins, pa.binary())], ["held", "kind", "label", "n", "bins"])

    made = rows.mapInArrow(run, "held boolean, kind int, label double, n bigint, bins binary")
    return made.groupBy("held", "kind", "label", "bins").agg(F.sum("n").alias("n"))


def _arrays(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Bins, labels, counts and kinds."""
    x = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, FEATURES).astype(np.int64)
    return x, *(np.asarray(rows.column(c).to_pylist(), t) for c, t in (("label", np.float64), ("n", np.int64), ("kind", np.int64)))


def _added(rows: DataFrame, cells: Callable[..., np.ndarray]) -> Callable[[int], np.ndarray]:
    """The whole numbers that ``cells`` makes of the arrays of some rows, added up over all rows by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(cells(*_arrays(b)).ravel() for b in batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.atleast_1d(total)[at], pa.int64())], ["cell", "n"])

    found = rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect()

    def laid_out(*shape: int) -> np.ndarray:
        whole = np.zeros(shape, np.int64)
        for cell, n in found:
            whole.flat[cell] = n
        return whole

    return laid_out


def _by_step(trees: boosting.Trees, x: np.ndarray, y: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Number of rows by kind, probability in steps, and label; the trees' limits are bins."""
    found = np.zeros((len(KINDS), STEPS + 1, 2), np.int64)
    np.add.at(found, (kind, np.floor(trees.probability(x) * STEPS).astype(np.int64), y.astype(np.int64)), n)
    return found


def fit(docs: DataFrame, text_column: str = "text", rounds: int = 40) -> Model:
    """Trees from the labelled rows of every text, each text counted once.

    A fifth of the texts is held out to set, for each kind, the threshold with the wanted precision. A kind without
    held-out positives gets threshold 1, which selects nothing. The driver holds sums by node, feature and bin.
    """
    rows = stage(labelled_rows(docs, text_column), "pii-labelled")
    cuts = _cuts(rows)
    table = stage(_binned(rows, cuts), "pii-binned")
    train, held = table.where("not held").drop("held"), table.where("held").drop("held")
    distinct, n, positive = table.agg(F.count("*"), F.sum(F.expr("if(held, 0, n)")), F.sum(F.expr("if(held, 0, n * label)"))).first()
    if distinct <= LOCAL_ROWS:
        x, y, count, _ = _arrays(train.toArrow())
        sums = boosting.sums_of(x, y, count)
    else:
        def sums(trees: boosting.Trees, level: int) -> np.ndarray:
            cells = lambda x, y, n, kind: boosting.level_sums(trees, level, x, y, n, trees.score(x))
            return _added(train, cells)(2**level, FEATURES, boosting.BINS, 2)

    over_bins = boosting.grow(sums, cuts, int(positive or 0), int(n or 0), rounds)
    counts = _added(held, lambda *arrays: _by_step(over_bins, *arrays))(len(KINDS), STEPS + 1, 2)
    steps, labels = np.repeat(np.arange(STEPS + 1) / STEPS, 2), np.tile([0.0, 1.0], STEPS + 1)
    limits = []
    for found in counts.reshape(len(KINDS), -1):
        some = found > 0
        limits.append(boosting.calibrated(steps[some], labels[some], PRECISION, LEAST, found[some]))
    return Model(over_bins.over(cuts), tuple(limits))


# ---- operators -------------------------------------------------------------------------------------------
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])


def find_spans(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and ``spans`` of every whole text, in code points, by start and then kind.

    Null and empty texts have none. Strict spans of different kinds may overlap; others overlap nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "score": s.score, "base": s.base} for s in shared.value.spans(t)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(_SPAN))], ["row", "spans"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, spans {SPANS}"
    return rows.mapInArrow(run, schema).select("row.*", "spans")


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first."""
    out, done, i = [], 0, 0
    while i < len(spans):
        s, end = spans[i], spans[i].end
        while i + 1 < len(spans) and spans[i + 1].start < end:
            i += 1
            end = max(end, spans[i].end)
        out += [text[done : s.start], f"[{KINDS[s.kind].upper()}]"]
        done, i = end, i + 1
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: Model, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with spans replaced, and the length column (if there) set to the new length.

    Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_column)).alias("row"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t if t is None else redacted(t, shared.value.spans(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("text").alias(name)
        if name == length_column:
            return F.char_length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return made.select(*(column(c) for c in docs.columns))
