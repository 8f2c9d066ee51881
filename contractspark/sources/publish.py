"""Several output folders that appear together or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..session import located, remove


def publish(spark: SparkSession, writes: dict[str, Callable[[str], None]]) -> None:
    """Writes each output into a pending folder beside it, then puts all of them in place.

    ``writes`` maps an output path to a function that writes to the path it is given. If one of them
    fails, every output stays what it was and the pending folders are removed. Once all are written, a
    manifest beside the first output names the moves; it is the commit. A job lost during the moves
    leaves the manifest, and :func:`finish`, which each call starts with, does the moves that are left.
    """
    outputs = [path.rstrip("/") for path in writes]
    manifest = _manifest(outputs[0])
    finish(spark, outputs[0])
    mark = uuid.uuid4().hex
    moves = [{"pending": _beside(o, f"_pending-{mark}"), "output": o, "old": _beside(o, f"_old-{mark}")} for o in outputs]
    try:
        for move, write in zip(moves, writes.values()):
            write(move["pending"])
    except BaseException:
        for move in moves:
            remove(spark, move["pending"])
        raise
    fs, path = located(spark, manifest)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}-{mark}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(moves), "utf-8"))
    stream.close()
    _moved(fs.rename(draft, path), manifest)
    finish(spark, outputs[0])


def finish(spark: SparkSession, output: str) -> bool:
    """Does the moves of a manifest left beside ``output`` (the first of its outputs); False if there is none.

    Each move may have been done already, so this can itself be repeated.
    """
    fs, manifest = located(spark, _manifest(output.rstrip("/")))
    if not fs.exists(manifest):
        return False
    stream = fs.open(manifest)
    moves = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    at = {key: [spark._jvm.org.apache.hadoop.fs.Path(m[key]) for m in moves] for key in ("pending", "output", "old")}
    for pending, final, old in zip(at["pending"], at["output"], at["old"]):
        files = pending.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(pending):
            if files.exists(final):
                _moved(files.rename(final, old), final)
            _moved(files.rename(pending, final), final)
    for move in moves:
        remove(spark, move["old"])
    fs.delete(manifest, False)
    return True


def _beside(output: str, prefix: str) -> str:
    """A sibling that file readers skip: its name starts with an underscore."""
    parent, _, name = output.rpartition("/")
    return f"{parent}/{prefix}-{name}" if parent or output.startswith("/") else f"{prefix}-{name}"


def _manifest(output: str) -> str:
    return _beside(output, ".publish")


def _moved(done: bool, path) -> None:
    if not done:
        raise OSError(f"could not move to {path}")
