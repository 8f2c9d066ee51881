"""Continuous ingest: candidate generations in, accepted and cleaned chat examples out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.candidates import candidate_examples, valid_attempts
from ..operators.cleaning import clean_examples
from ..rules import MAX_ATTEMPTS

_ACCEPTED = "example_id bigint, attempt int, raw_content string"
_OUTPUT_ROWS = 10_000


def read_candidates(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schemas.CANDIDATE).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def accepted_candidates(candidates: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The valid attempt that settles each example: the earliest of the first micro-batch that has one.

    Only valid candidates are shuffled, by id, so that a micro-batch's attempts of an example are in one task,
    which keeps the earliest of each. Settled ids are the keyed state of Spark's own deduplication: a later batch
    looks its ids up in the state store and reads nothing that was written before. Equal attempts are settled by
    their text; candidates without an id settle one example without an id.
    """
    together = valid_attempts(candidates, max_attempts).repartition("example_id")
    return together.mapInArrow(_earliest, _ACCEPTED).dropDuplicates(["example_id"])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best: dict = {}
    for batch in batches:  # one at a time: an example may have any number of candidates
        ids, *found = (batch.column(name).to_pylist() for name in ("example_id", "attempt", "raw_content"))
        for key, row in zip(ids, zip(*found)):
            if key not in best or row < best[key]:
                best[key] = row
    rows = iter(best.items())
    while part := list(islice(rows, _OUTPUT_ROWS)):
        columns = zip(*((key, *row) for key, row in part))
        types = (pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["example_id", "attempt", "raw_content"])


def ingest_candidates(candidates: DataFrame, accepted_path: str, checkpoint: str) -> StreamingQuery:
    """Starts the job; it handles all data there is and then stops.

    Accepted examples are cleaned and appended to a Parquet sink. State, source offsets and the sink's log
    share the checkpoint, so a batch that is replayed after a failure yields the same rows and is written
    once. Read the folder with Spark, which follows the sink's log.
    """
    cleaned = clean_examples(candidate_examples(accepted_candidates(candidates)))
    return (
        cleaned.writeStream.format("parquet").outputMode("append")
        .option("path", accepted_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
