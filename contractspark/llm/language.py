"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Scores gathered at a time, over all languages.
_AT_ONCE = 1 << 20


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, each followed by two spaces, and where each text begins.

    Two spaces lead, so that an n-gram that ends in a text or its two spaces holds nothing of another text.
    """
    lower = [t.lower() + "  " for t in texts]
    points = np.frombuffer(("  " + "".join(lower)).encode("utf-32-le"), "<u4")
    starts = np.cumsum([2, *map(len, lower)])[:-1]
    return points, starts


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each place from the third on, the buckets of the n-grams of two and of three characters that end there."""
    c = points.astype(np.uint32)
    two = c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)
    for code in (two, two + c[:-2] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)):
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        yield code >> np.uint32(32 - BUCKET_BITS)


@dataclass(frozen=True)
class Model:
    """``weights[bucket, language]``: log-probabilities; ``priors[language]``."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n, languages = len(texts), len(self.languages)
        if not languages or not n:
            return [UNKNOWN] * n, [0.0] * n
        points, starts = joined(texts)
        total = np.repeat(self.priors[None, :], n, axis=0)
        step = max(1024, _AT_ONCE // languages)
        for buckets in grams(points):
            for at in range(0, len(buckets), step):  # entry i belongs to the place i + 2
                part = buckets[at : at + step]
                first = int(np.searchsorted(starts, at + 2, side="right")) - 1
                last = int(np.searchsorted(starts, at + 2 + len(part) - 1, side="right"))
                begins = np.maximum(starts[first:last] - 2 - at, 0)
                total[first:last] += np.add.reduceat(self.weights[part], begins, axis=0)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = [bool(_LETTER.search(t)) for t in texts]
        return (
            [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)],
            [s if k else 0.0 for s, k in zip(share.tolist(), known)],
        )


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", smoothing: float = 0.5) -> Model:
    """Counts the n-grams of all rows with a label and a text.

    Each task adds up its rows and hands on one count per label and bucket, so shuffle and result are
    bounded by the number of labels times ``BUCKETS``, which must fit the driver (a quarter of a MB for a
    language). Without labelled rows the model knows no language.
    """
    rows = labelled.where(F.col(text_column).isNotNull() & F.col(label_column).isNotNull())
    rows = rows.select(F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            by_label: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_label.setdefault(lang, []).append(text)
            for lang, texts in by_label.items():
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += len(texts)
                for buckets in grams(joined(texts)[0]):
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[table["bucket"], np.searchsorted(languages, table["lang"]) if languages else []] = table["n"]
    grams_of = counts[:BUCKETS] + smoothing
    return Model(languages, np.log(grams_of / grams_of.sum(axis=0)), np.log(counts[BUCKETS] / max(1, counts[BUCKETS].sum())))


def identify(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (posterior probability) of every whole text.

    ``und`` with score 0 for null texts and texts without a letter. Texts are scored in batches against
    the broadcast matrix; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"]
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out(id_column: str = "doc_id") -> Column:
    """One row in four by the id; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))
