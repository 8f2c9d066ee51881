"""Prediction parsing, scoring and metrics per model and document type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_stripped
from ..functions.flags import document_type, document_type_of_lower, truth_is_flagged
from ..functions.grounding import is_unsupported, lower_is_populated, normal_is_populated
from ..functions.jsonx import with_closed, with_field_texts, with_strict_label
from ..functions.messages import first_of_role
from ..functions.outputs import with_unfenced
from ..functions.repetition import loop_position
from ..functions.scoring import normal_token_set, party_key, party_set, with_set_scores
from ..functions.text import apart, let, normalize_lower, strip_stored
from ..rules import DEFAULT_RULES, DOC_TYPES, FIELDS, LOOP_MIN_LEN, LOOP_REPEATS, METRIC_LABELS, RuleSet

OVERALL = "overall"
RATES = tuple(name for name, _ in METRIC_LABELS)
METRICS = RATES + tuple(f"f1_{f}" for f in FIELDS)


def align_predictions(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """Each prediction next to its example; predictions of unknown examples are left out."""
    return predictions.join(examples, "example_id")


def parse_outputs(outputs: DataFrame, text: str = "output_text") -> DataFrame:
    """Adds ``pred_<field>`` texts, ``parse_failed`` and ``was_truncated``.

    Only a text that is not one JSON object, and is long enough to loop, goes to the repetition
    search; if a loop was cut the rest is closed and parsed again.
    """
    direct, loop_at = F.col("_direct"), F.col("_loop_at")
    searched = direct.isNull() & (F.length("_text") > LOOP_MIN_LEN * LOOP_REPEATS)
    rest = F.when(loop_at >= 0, F.substring(F.col("_text"), F.lit(1), loop_at))
    parsed = with_strict_label(with_unfenced(outputs, text, "_text"), "_text", "_direct")
    cut = parsed.withColumn("_loop_at", loop_position(F.when(searched, F.col("_text")))).withColumn("_rest", rest)
    salvaged = with_strict_label(with_closed(cut, "_rest", "_rest"), "_rest", "_salvaged")
    return (
        with_field_texts(salvaged.withColumn("_label", F.coalesce(direct, F.col("_salvaged"))), "_label", "pred_")
        .withColumn("parse_failed", F.col("_label").isNull())
        .withColumn("was_truncated", loop_at >= 0)
        .drop("_text", "_direct", "_loop_at", "_rest", "_salvaged", "_label")
    )


def _with_keys(rows: DataFrame, texts: dict[str, str], prefix: str) -> DataFrame:
    """Adds, per field, ``<prefix><field>``: the text that its score compares, computed once per side.

    ``_normal_<field>`` and ``_lower_parties`` stay at hand for what else is asked of a field's text.
    """
    date = texts["effective_date"]
    stored = rows.withColumns({f"_lower_{f}": F.lower(F.col(t)) for f, t in texts.items()}).withColumns({
        **{f"_normal_{f}": normalize_lower(F.col(f"_lower_{f}")) for f in FIELDS},
        "_date": let(F.col(date), strip_stored),
    })
    keys = {f: F.col(f"_normal_{f}") for f in FIELDS}
    keys["liability_cap"] = apart(keys["liability_cap"])
    keys["parties"] = party_key(F.col(texts["parties"]))
    keys["effective_date"] = F.coalesce(parse_stripped(F.col("_date")).cast("string"), keys["effective_date"])
    return stored.withColumns({f"{prefix}{f}": key for f, key in keys.items()})


def prepare_truth(examples: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Per example, everything scoring needs: normalised source, truth sets, flags, document type.

    Computed before the join with the predictions, hence once per example rather than per model.
    """
    text = {f: f"_text_{f}" for f in FIELDS}
    source = F.coalesce(first_of_role(F.col("messages"), "user"), F.lit(""))
    told = examples.select(
        "example_id", source.alias("_source"), first_of_role(F.col("messages"), "assistant").alias("_told"),
    ).withColumn("_lower_source", F.lower("_source"))
    labelled = with_field_texts(with_strict_label(told, "_told", "_label"), "_label", "_text_")
    populated = {f: normal_is_populated(F.col(text[f]), F.col(f"_normal_{f}")) for f in FIELDS}
    populated["parties"] = lower_is_populated(F.col("_lower_parties"))  # their normal form is not asked for here
    return _with_keys(labelled, text, "truth_").select(
        "example_id",
        normalize_lower(F.col("_lower_source")).alias("source"),
        document_type_of_lower(F.col("_lower_source"), rules).alias("doc_type"),
        truth_is_flagged(F.col("_normal_effective_date"), F.col("_lower_parties"), rules).alias("flagged"),
        *[f"truth_{f}" for f in FIELDS],
        *[column.alias(f"populated_{f}") for f, column in populated.items()],
    )


def score_predictions(predictions: DataFrame, examples: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Per model and example: ``doc_type, parse_failed, was_truncated, flagged`` and, per field,
    ``score_*``, ``hallucinated_*`` and ``populated_*``. One join on ``example_id``."""
    pred = {f: f"pred_{f}" for f in FIELDS}
    key = {f: F.col(f"key_{f}") for f in FIELDS}
    normal = {f: F.col(f"_normal_{f}") for f in FIELDS}
    claims = {f: F.col(p).isNotNull() & normal_is_populated(F.col(p), normal[f]) for f, p in pred.items()}
    # A claim is looked up in its normal form; the join carries that only where it is not the key.
    apart_from_key = ("parties", "effective_date")
    parsed = _with_keys(parse_outputs(predictions), pred, "key_").select(
        "model", "example_id", "parse_failed", "was_truncated", *key.values(),
        *[claim.alias(f"_claims_{f}") for f, claim in claims.items()],
        *[F.when(claims[f] & (normal[f] != key[f]), normal[f]).alias(f"_claim_{f}") for f in apart_from_key],
    )
    claim = key | {f: F.coalesce(F.col(f"_claim_{f}"), key[f]) for f in apart_from_key}
    splitters = dict.fromkeys(FIELDS, normal_token_set) | {"parties": party_set}
    del splitters["effective_date"]
    pairs = with_set_scores(
        align_predictions(parsed, prepare_truth(examples, rules)),
        {f"score_{f}": (f"key_{f}", f"truth_{f}", split) for f, split in splitters.items()},
    )
    same_date = F.col("key_effective_date") == F.col("truth_effective_date")
    score = {f: F.col(f"score_{f}") for f in splitters}
    score["effective_date"] = F.when(same_date, F.lit(1.0)).otherwise(F.lit(0.0))
    return pairs.select(
        "model", "example_id", "doc_type", "parse_failed", "was_truncated", "flagged",
        *[score[f].alias(f"score_{f}") for f in FIELDS],
        *[
            is_unsupported(F.col(f"_claims_{f}"), claim[f], F.col("source")).alias(f"hallucinated_{f}")
            for f in FIELDS
        ],
        *[f"populated_{f}" for f in FIELDS],
    )


def _sums(scored: DataFrame) -> DataFrame:
    """Partial sums per model and document type; everything a metric needs adds up."""
    scores = [F.col(f"score_{f}") for f in FIELDS]
    wrong = [F.col(f"hallucinated_{f}") for f in FIELDS]
    filled = [F.col(f"populated_{f}") for f in FIELDS]

    def total(parts: Iterable[Column]) -> Column:
        return sum((p.cast("bigint") for p in parts), F.lit(0).cast("bigint"))

    exact = scores[0] == 1.0
    for s in scores[1:]:
        exact = exact & (s == 1.0)
    return scored.groupBy("model", "doc_type").agg(
        F.count("*").alias("n"),
        F.sum(sum(scores[1:], scores[0]) / len(FIELDS)).alias("s_f1"),
        F.count_if(exact).alias("s_exact"),
        F.sum(total(wrong)).alias("s_wrong"),
        F.sum(total(filled)).alias("s_filled"),
        F.sum(total(w & p for w, p in zip(wrong, filled))).alias("s_wrong_filled"),
        F.count_if("parse_failed").alias("s_failed"),
        F.count_if("was_truncated").alias("s_truncated"),
        F.count_if("flagged").alias("s_flagged"),
        *[F.sum(s).alias(f"s_{f}") for f, s in zip(FIELDS, scores)],
    )


def _finish(sums: DataFrame, keys: list[str]) -> DataFrame:
    def percent(part: str, whole: Column) -> Column:
        share = F.col(part) / F.nullif(whole, F.lit(0))
        return F.coalesce(F.round(share * 100, 2), F.lit(0.0))

    n = F.col("n")
    formulas = {
        "overall_f1": percent("s_f1", n),
        "exact_match_rate": percent("s_exact", n),
        "hallucination_rate": percent("s_wrong", n * len(FIELDS)),
        "hallucination_rate_on_populated_fields": percent("s_wrong_filled", F.col("s_filled")),
        "json_parse_failure_rate": percent("s_failed", n),
        "salvaged_via_truncation_rate": percent("s_truncated", n),
        "flagged_ground_truth_rate": percent("s_flagged", n),
        **{f"f1_{f}": percent(f"s_{f}", n) for f in FIELDS},
    }
    return sums.select(*keys, "n", *[column.alias(name) for name, column in formulas.items()])


def metrics_by_type(scored: DataFrame) -> DataFrame:
    """Metrics per model for ``scope`` = overall and each document type, zeros where a type is empty.

    The scored rows are aggregated once; the scopes are built from the few rows of partial sums.
    """
    sums = _sums(scored)
    measured = [c for c in sums.columns if c not in ("model", "doc_type")]
    scopes = F.explode(F.array(*[F.lit(s) for s in (OVERALL, *DOC_TYPES)]))
    counted = F.col("scope").isin(OVERALL) | (F.col("scope") == F.col("doc_type"))
    by_scope = (
        sums.withColumn("scope", scopes)
        .groupBy("model", "scope")
        .agg(*[F.sum(F.when(counted, F.col(c)).otherwise(F.lit(0))).alias(c) for c in measured])
    )
    return _finish(by_scope, ["model", "scope"])


def eval_metrics(scored: DataFrame) -> DataFrame:
    """Metrics per model over all its predictions."""
    return metrics_by_type(scored).where(F.col("scope") == OVERALL).drop("scope")


def doc_type_counts(examples: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """``doc_type, n``: a row for every type, also for one without examples."""
    kind = document_type(F.coalesce(first_of_role(F.col("messages"), "user"), F.lit("")), rules)
    typed = examples.select(kind.alias("doc_type"))
    counts = typed.agg(*[F.count_if(F.col("doc_type") == t).alias(t) for t in DOC_TYPES])
    return counts.unpivot([], list(DOC_TYPES), "doc_type", "n")
