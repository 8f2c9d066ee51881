"""Seeded, exact-size train/eval split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import EVAL_FRACTION, SPLIT_SEED
from ..session import remove, shared_folder, staged

_BUCKET_CHARS = 4  # 65,536 hash buckets
#: Buckets on either side of the wanted share whose digests are kept in the first pass. The share of ids below a
#: bucket strays from the bucket's own share by about 65,536 * sqrt(f * (1 - f) / n) buckets, 33 of them for a million ids.
NEAR_BUCKETS = 128


def _digest(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))


def _cutoff(df: DataFrame, fraction: float, seed: int, id_column: str) -> str | None:
    """The largest digest that still belongs to the eval part, None without ids.

    One pass over the id column gives counts per bucket (the leading digest characters) and, for the
    buckets near the wanted share, per digest; both combine map-side, also for an id on very many rows.
    The table is written, the bucket in which the wanted count is reached is found in it, and only that
    bucket's digests (1/65,536 of them) are ranked. With few ids that bucket may lie further away: then
    its digests are read from the input in a second pass.
    """
    digest, bucket = F.col("digest"), F.col("bucket")
    digests = df.where(F.col(id_column).isNotNull()).select(_digest(id_column, seed).alias("digest")).withColumn(
        "bucket", F.conv(F.substring(digest, 1, _BUCKET_CHARS), 16, 10).cast("int")
    )
    middle = int(fraction * 16**_BUCKET_CHARS)
    near = bucket.between(middle - NEAR_BUCKETS, middle + NEAR_BUCKETS)
    path = shared_folder(df.sparkSession, "split")
    counts = staged(
        digests.groupBy("bucket", F.when(near, digest).alias("digest")).agg(F.count("*").alias("n")), path
    )
    upto = F.sum("n").over(Window.orderBy("bucket"))
    wanted = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(float(fraction))))
    edge = (
        counts.groupBy("bucket").agg(F.sum("n").alias("n"))
        .select("bucket", "n", upto.alias("upto"), wanted.alias("wanted"))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select("bucket", (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("take"))
        .first()
    )
    cut = None
    if edge is not None:
        inside = counts.where(bucket == edge.bucket)
        if abs(edge.bucket - middle) > NEAR_BUCKETS:
            inside = digests.where(bucket == edge.bucket).groupBy("digest").agg(F.count("*").alias("n"))
        running = inside.select("digest", F.sum("n").over(Window.orderBy("digest")).alias("upto"))
        cut = running.where(F.col("upto") >= edge["take"]).agg(F.min("digest")).first()[0]
    remove(df.sparkSession, path)
    return cut


def split_train_eval(
    df: DataFrame, fraction: float = EVAL_FRACTION, seed: int = SPLIT_SEED, id_column: str = "example_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, eval): eval holds exactly max(1, floor(n * fraction)) of the n rows with an id, train all others.

    Membership is a comparison of each id's digest with one cut-off value, found when this is called, so
    the rows themselves are neither sorted nor shuffled; every row is in exactly one part. Rows without an
    id are in train, rows of one id are in the same part, so the size is exact where ids are unique (else
    the eval part ends with all rows of the id that reaches it).
    """
    cut = _cutoff(df, fraction, seed, id_column)
    in_eval = F.lit(False) if cut is None else F.coalesce(_digest(id_column, seed) <= F.lit(cut), F.lit(False))
    return df.where(~in_eval), df.where(in_eval)
