"""Generated candidates: prompts out, validated chat examples in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.grounding import comparable, found_in
from ..functions.jsonx import as_text, elements, kind, strict_label, stringify, text_of_kind
from ..functions.messages import chat
from ..rules import CONTRACT_TYPES, MAX_ATTEMPTS, PROMPT_HEAD, PROMPT_TAIL, candidate_json_schema


def seeded_bucket(key: Column, buckets: int, seed: int) -> Column:
    """Reproducible bucket 0..buckets-1 of a key: 32 bits of an md5 over seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def assign_prompts(
    requests: DataFrame, id_column: str = "example_id", seed: int = 42,
    contract_types: Sequence[str] = CONTRACT_TYPES, schema_text: str | None = None,
) -> DataFrame:
    """Adds ``contract_type`` (a seeded pick) and the generation ``prompt``."""
    pick = seeded_bucket(F.col(id_column), len(contract_types), seed)
    kinds = F.array(*[F.lit(t) for t in contract_types])
    tail = PROMPT_TAIL + (schema_text or candidate_json_schema()) + "\n"
    return requests.withColumn("contract_type", F.element_at(kinds, (pick + 1).cast("int"))).withColumn(
        "prompt", F.concat(F.lit(PROMPT_HEAD), F.col("contract_type"), F.lit(tail))
    )


def validate_candidates(candidates: DataFrame, content: str = "raw_content") -> DataFrame:
    """Adds ``label`` (parsed), ``reason`` (first failing check, NULL when fine) and ``valid``.

    Each party, the effective date and the liability cap must be grounded in ``messy_text``; the
    termination conditions are not checked. Stateless, so it also runs on streams.
    """
    label = F.col("label")
    parsed = candidates.withColumn("label", strict_label(F.col(content), schemas.CANDIDATE_LABEL))
    kinds = {f"_kind_{f}": kind(label[f]) for f in ("messy_text", "parties", "effective_date", "liability_cap")}
    text_kind, list_kind = F.col("_kind_messy_text"), F.col("_kind_parties")
    entries = (
        F.when(list_kind == "ARRAY<STRING>", F.try_variant_get(label["parties"], "$", "array<string>"))
        .when(F.startswith(list_kind, F.lit("ARRAY")), F.transform(elements(label["parties"]), lambda p: stringify(p)))
        .when(list_kind == "STRING", F.array(as_text(label["parties"])))
    )
    texts = {
        "_text": F.when(text_kind == "STRING", as_text(label["messy_text"])),
        "_parties": F.transform(entries, lambda p: comparable(p)),
        "_date": comparable(text_of_kind(label["effective_date"], F.col("_kind_effective_date"))),
        "_cap": comparable(text_of_kind(label["liability_cap"], F.col("_kind_liability_cap"))),
    }
    source = F.col("_source")
    reason = (
        F.when(label.isNull(), "bad_json")
        .when(label["parties"].isNotNull() & F.col("_parties").isNull(), "parties_type")
        .when(F.exists("_parties", lambda p: ~found_in(p, source)), "party")
        .when(~found_in(F.col("_date"), source), "effective_date")
        .when(~found_in(F.col("_cap"), source), "liability_cap")
        .when(F.col("_text").isNull(), "no_messy_text")
    )
    return (
        parsed.withColumns(kinds)
        .withColumns(texts)
        .withColumn("_source", F.coalesce(F.lower("_text"), F.lit("")))
        .withColumn("reason", reason)
        .withColumn("valid", F.col("reason").isNull())
        .drop("_source", *kinds, *texts)
    )


def candidate_examples(accepted: DataFrame, content: str = "raw_content") -> DataFrame:
    """Accepted candidates as chat examples: the text asks, the label without the text answers.

    The content is parsed once, as an open map, so unknown keys stay; of a key given twice the last text counts.
    """
    fields = F.col("_fields")
    texts = F.map_values(F.map_filter(fields, lambda k, v: k == "messy_text"))
    answer = F.to_json(F.map_filter(fields, lambda k, v: k != "messy_text"))
    return accepted.withColumn("_fields", F.from_json(F.col(content), "map<string,variant>")).select(
        "example_id", "attempt", chat(as_text(F.try_element_at(texts, F.lit(-1))), answer).alias("messages")
    )


def valid_attempts(candidates: DataFrame, max_attempts: int = MAX_ATTEMPTS, *others: str) -> DataFrame:
    """``example_id, attempt, raw_content`` (and ``others``) of the valid candidates among the first attempts.

    An explode of one or no row instead of a filter: a filter would be pushed below the projections and
    repeat the parsing and validation it depends on. Map stages only, so it also runs on streams.
    """
    tried = validate_candidates(candidates.where(F.col("attempt") < max_attempts))
    row = F.struct("example_id", F.col("attempt").cast("int").alias("attempt"), "raw_content", *others)
    return tried.select(F.explode(F.when(F.col("valid"), F.array(row))).alias("row")).select("row.*")


def first_valid_attempt(candidates: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The earliest valid attempt of each example; examples without one give no row.

    ``min_by`` combines map-side, so one example with very many attempts costs one row per task, and only
    the earliest valid text of each example and task is shuffled. (Aggregating keys alone and joining the
    texts to them would read every text twice and shuffle the losing ones too.)
    Validity is a condition of the aggregate, not a filter before it: a filter would be pushed below
    the projections and repeat the parsing and validation it depends on.
    """
    tried = validate_candidates(candidates.where(F.col("attempt") < max_attempts))
    attempt = F.when(F.col("valid"), F.col("attempt"))
    accepted = tried.groupBy("example_id").agg(
        F.min(attempt).alias("attempt"), F.min_by("raw_content", attempt).alias("raw_content")
    )
    return candidate_examples(accepted.where(F.col("attempt").isNotNull()))
