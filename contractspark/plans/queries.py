"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame`` with flat, named columns."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, flags, grounding, jsonx, messages, parties, scoring, text
from ..functions.outputs import unfence
from ..functions.repetition import loop_position
from ..operators import (
    audit, candidates, chunking, cleaning, dataset, documents, evaluation, indexing, merging, qa, reporting, split,
)
from ..operators.extract import document_status, extract
from ..rules import DEMO_TEXT_CHARS, FIELDS, QA_CONTEXT_CHARS, SCALAR_FIELDS
from ..session import shared_folder
from ..sources import payload, tables
from ..streaming import ingest
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MODELS = ("base", "tuned")
PAGE_BUDGET = 200  # small, so that the short fixture documents split and some pages are oversize


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(column: str | Column, sep: str = "|") -> Column:
    return F.array_join(F.col(column) if isinstance(column, str) else column, sep)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.with_label(fx.examples(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_predictions(fx.predictions(spark, sf), fx.examples(spark, sf))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and true field texts side by side."""
    truth = jsonx.with_field_texts(_labelled(spark, sf), "label", "true_").select(
        "example_id", *[f"true_{f}" for f in FIELDS]
    )
    return evaluation.align_predictions(evaluation.parse_outputs(fx.predictions(spark, sf)), truth)


def _varied(spark: SparkSession, sf: str) -> DataFrame:
    """Examples, some without an assistant message and some with two."""
    extra = F.array(messages.message("assistant", F.lit("{}")))
    m, id_ = F.col("messages"), F.col("example_id")
    varied = F.when(id_ % 5 == 0, F.slice(m, 1, 2)).when(id_ % 5 == 1, F.concat(extra, m)).otherwise(m)
    return fx.examples(spark, sf).withColumn("messages", varied)


# ---- sources, sinks --------------------------------------------------------------------------------
@query
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "examples-jsonl")
    tables.append_examples(fx.examples(spark, sf), path)
    return tables.read_examples(spark, path).select(
        "example_id", F.size("messages").alias("n_messages"),
        messages.first_of_role(F.col("messages"), "user").alias("user_text"),
        messages.first_of_role(F.col("messages"), "assistant").alias("assistant_text"),
    )


def _faulty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """fx_examples as lines with a sibling key, some of them bad or blank."""
    id_ = F.col("example_id")
    line = F.to_json(F.struct("example_id", "messages", F.concat(F.lit("n"), id_).alias("note")))
    kind = id_ % 50
    bad = (
        F.when(kind == 1, F.substring(line, 1, 40)).when(kind == 2, F.concat(line, F.lit(" {}"))).when(kind == 3, F.lit("[1, 2]"))
        .when(kind == 4, F.lit('{"messages": "none"}')).when(kind == 5, F.lit('{"example_id": "x"}')).when(kind == 6, F.lit("  "))
    )
    return fx.examples(spark, sf).select(F.coalesce(bad, line).alias("value"))


@query
def scan_open_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with sibling keys, bad ones quarantined with a reason and an id of their own."""
    path = shared_folder(spark, "open-jsonl")
    _faulty_lines(spark, sf).write.text(path)
    lines = tables.read_open_examples(spark, path, quarantine=True)
    good = F.col("reason").isNull()
    return lines.select(
        F.when(good, F.col("example_id")).otherwise(-1).alias("example_id"), (F.col("example_id") >= tables.OWN_IDS).alias("own_id"), "reason",
        F.coalesce(F.size("messages"), F.lit(-1)).alias("n_messages"), jsonx.as_text(F.col("fields")["note"]).alias("note"), F.col(jsonx.CORRUPT).alias("bad_line"),
    )


@query
def clean_open_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned file of lines with sibling keys, read again: bad lines are left out, no line is blank."""
    base = shared_folder(spark, "open-clean")
    _faulty_lines(spark, sf).write.text(f"{base}/in")
    lines = tables.read_open_examples(spark, f"{base}/in", quarantine=True)
    tables.write_cleaned(lines, f"{base}/cleaned", f"{base}/report", quarantine_path=f"{base}/bad")
    return tables.read_open_examples(spark, f"{base}/cleaned").select(
        "example_id", F.size("messages").alias("n_messages"), jsonx.as_text(F.col("fields")["note"]).alias("note"),
        messages.first_of_role(F.col("messages"), "user").alias("user_text"),
    )


@query
def split_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Split sizes over lines without ids: each line has one by its place and is in exactly one part."""
    path = shared_folder(spark, "no-ids")
    fx.examples(spark, sf).select("messages").write.json(path)
    train, held_out = split.split_train_eval(tables.read_examples(spark, path))
    texts = [p.select(messages.first_of_role(F.col("messages"), "user").alias("t"), F.lit(part).alias("part")) for p, part in ((train, "train"), (held_out, "eval"))]
    return texts[0].unionByName(texts[1]).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("t").isNotNull()).alias("with_text"))


@query
def scan_qa(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "qa")
    tables.write_qa(fx.qa(spark, sf), path)
    return tables.read_qa(spark, path, "part-*.parquet").select(
        "row_id", "context", "question", F.size("answers.text").alias("n_answers"),
        qa.first_answer(F.col("answers")).alias("answer"),
    )


@query
def carve_payload(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.encode(F.col("body_text"), "UTF-8")
    odd = F.col("page_id") % 2 == 1
    uploads = fx.load(spark, sf, "fx_payload").select(
        "page_id", odd.alias("is_base64"), F.when(odd, F.base64(raw).cast("binary")).otherwise(raw).alias("body")
    )
    return payload.carve_payload(uploads).select("page_id", F.decode("payload", "UTF-8").alias("payload"), "error")


@query
def doc_text(spark: SparkSession, sf: str) -> DataFrame:
    return documents.doc_text(fx.load(spark, sf, "fx_pages"))


# ---- candidates ------------------------------------------------------------------------------------
@query
def assign_prompt(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.load(spark, sf, "orders").select(F.col("o_orderkey").alias("example_id"))
    return candidates.assign_prompts(requests)


@query
def grounding_raw(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.col("example_id")
    value = (
        F.when(id_ % 4 == 0, F.col("label_p1")).when(id_ % 4 == 1, F.lit("Zyxwv Quorum"))
        .when(id_ % 4 == 2, F.concat(F.col("label_term"), F.lit(" plus unknown"))).otherwise(F.lit(" N/A "))
    )
    return fx.load(spark, sf, "fx_examples").select(
        "example_id", grounding.is_grounded(value, F.lower("user_text")).alias("grounded")
    )


@query
def validate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    checked = candidates.validate_candidates(fx.load(spark, sf, "fx_candidates"))
    return checked.select("example_id", "attempt", "valid", "reason")


@query
def first_valid_attempt(spark: SparkSession, sf: str) -> DataFrame:
    kept = candidates.first_valid_attempt(fx.load(spark, sf, "fx_candidates"))
    answer = messages.first_of_role(F.col("messages"), "assistant")
    parsed = kept.withColumn("_answer", answer).withColumn("_label", jsonx.strict_label(F.col("_answer")))
    return parsed.select(
        "example_id", "attempt", messages.first_of_role(F.col("messages"), "user").alias("user_text"),
        *[jsonx.stringify(F.col("_label")[f]).alias(f) for f in FIELDS],
        F.get_json_object("_answer", "$.extra").alias("extra"),
        F.contains("_answer", F.lit("messy_text")).alias("has_text"),
    )


@query
def stream_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming job over candidate files, in several micro-batches."""
    base = shared_folder(spark, "stream")
    files = max(4, 2 * spark.sparkContext.defaultParallelism)
    fx.load(spark, sf, "fx_candidates").select("example_id", "attempt", "raw_content").repartition(
        files, "example_id"
    ).write.option("compression", "gzip").json(f"{base}/in")
    stream = ingest.read_candidates(spark, f"{base}/in", files_per_trigger=files // 2)
    ingest.ingest_candidates(stream, f"{base}/accepted", f"{base}/checkpoint").awaitTermination()
    accepted = spark.read.parquet(f"{base}/accepted")
    return accepted.select(
        "example_id", "attempt", messages.first_of_role(F.col("messages"), "user").alias("user_text"), "modified"
    )


# ---- expert answers --------------------------------------------------------------------------------
@query
def truncate_context(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, "documents").select(
        "doc_id", text.truncate(F.col("text"), QA_CONTEXT_CHARS, "...").alias("context"),
        text.truncate(F.col("text"), DEMO_TEXT_CHARS).alias("demo_text"),
    )


@query
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    return qa.route_questions(fx.qa(spark, sf))


@query
def qa_to_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return qa.qa_to_contracts(fx.qa(spark, sf)).withColumn("parties", _joined("parties"))


@query
def mix_datasets(spark: SparkSession, sf: str) -> DataFrame:
    real = qa.contract_examples(qa.qa_to_contracts(fx.qa(spark, sf)))
    mixed = qa.mix_datasets(fx.examples(spark, sf), real)
    return mixed.select(
        "source", "example_id", F.size("messages").alias("n_messages"),
        messages.first_of_role(F.col("messages"), "user").alias("user_text"),
        F.get_json_object(messages.first_of_role(F.col("messages"), "assistant"), "$.effective_date").alias("effective_date"),
    )


@query
def hybrid_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Generated examples and expert answers: mixed, cleaned, split, and the lengths of each part audited."""
    parts = dataset.hybrid_dataset(fx.examples(spark, sf), fx.qa(spark, sf))
    user = messages.first_of_role(F.col("messages"), "user")
    audits = [
        audit.length_audit(rows.where(F.col("source") == source), user, limit=100)
        .select(F.lit(part).alias("part"), F.lit(source).alias("source"), "*")
        for part, rows in zip(("train", "eval"), parts) for source in ("synthetic", "real")
    ]
    return functools.reduce(DataFrame.unionByName, audits)


@query
def evaluation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.evaluation_prompts(split.split_train_eval(fx.examples(spark, sf))[1])


# ---- chat examples ---------------------------------------------------------------------------------
@query
def build_examples(spark: SparkSession, sf: str) -> DataFrame:
    exploded = fx.examples(spark, sf).select("example_id", F.posexplode("messages").alias("pos", "m"))
    return exploded.select("example_id", "pos", "m.role", "m.content")


@query
def role_select(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    label = jsonx.strict_label(F.col("assistant_text"))
    return (
        _varied(spark, sf)
        .select(
            "example_id", messages.role_index(m, "assistant").alias("assistant_index"),
            messages.first_of_role(m, "user").alias("user_text"),
            messages.first_of_role(m, "assistant").alias("assistant_text"),
        )
        .withColumn("effective_date", jsonx.stringify(label["effective_date"]))
    )


@query
def prompt_messages(spark: SparkSession, sf: str) -> DataFrame:
    kept = messages.without_role(F.col("messages"), "assistant")
    exploded = _varied(spark, sf).select("example_id", F.posexplode(kept).alias("pos", "m"))
    return exploded.select("example_id", "pos", "m.role", "m.content")


@query
def exclude_empty(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.exclude_empty(_labelled(spark, sf)).select("example_id", "assistant_text")


@query
def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, "fx_pages").select("doc_id", "page_no", messages.render_prompt(F.col("text")).alias("prompt"))


@query
def render_training(spark: SparkSession, sf: str) -> DataFrame:
    return fx.examples(spark, sf).select("example_id", messages.render_chat(F.col("messages")).alias("training_text"))


@query
def doc_type(spark: SparkSession, sf: str) -> DataFrame:
    user = messages.first_of_role(F.col("messages"), "user")
    return fx.examples(spark, sf).select("example_id", flags.document_type(user).alias("doc_type"))


@query
def doc_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.doc_type_counts(fx.examples(spark, sf))


@query
def flag_dates(spark: SparkSession, sf: str) -> DataFrame:
    flag = flags.date_is_suspicious(F.col("label")["effective_date"])
    return _labelled(spark, sf).select("example_id", flag.alias("flagged"))


@query
def flag_truth(spark: SparkSession, sf: str) -> DataFrame:
    fields = jsonx.with_field_texts(_labelled(spark, sf), "label")
    found = flags.truth_flags(F.col("effective_date"), F.col("parties"))
    return fields.select("example_id", _joined(found).alias("flags"))


@query
def stringify(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("example_id", *[jsonx.stringify(F.col("label")[f]).alias(f) for f in FIELDS])


# ---- cleaning --------------------------------------------------------------------------------------
@query
def clean_entries(spark: SparkSession, sf: str) -> DataFrame:
    items = parties.clean_parties(F.col("label")["parties"])
    return _labelled(spark, sf).select("example_id", F.posexplode(items).alias("pos", "item")).select(
        "example_id", "pos", "item.original", "item.cleaned", "item.reason"
    )


@query
def clean_parties(spark: SparkSession, sf: str) -> DataFrame:
    items = parties.clean_parties(F.col("label")["parties"])
    return cleaning.exclude_empty(_labelled(spark, sf)).withColumn("items", items).select(
        "example_id", _joined(parties.kept_entries(F.col("items"))).alias("kept"),
        _joined(parties.dropped_entries(F.col("items"))).alias("dropped"),
        F.size(parties.truncated_pairs(F.col("items"))).alias("n_truncated"),
    )


@query
def clean_examples(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = cleaning.with_label(cleaning.clean_examples(fx.examples(spark, sf)))
    return cleaned.select(
        "example_id", "modified", "effective_date_flagged",
        *[jsonx.stringify(F.col("label")[f]).alias(f) for f in FIELDS],
    )


@query
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    report = cleaning.cleaning_report(cleaning.clean_examples(fx.examples(spark, sf)))
    pair = F.transform("parties_truncated", lambda p: F.concat_ws(" => ", p["original"], p["cleaned"]))
    return report.select(
        "example_index", "example_id", _joined("parties_dropped").alias("parties_dropped"),
        _joined(pair).alias("parties_truncated"), "effective_date_flagged", "modified",
    )


@query
def report_index(spark: SparkSession, sf: str) -> DataFrame:
    survivors = cleaning.exclude_empty(_labelled(spark, sf)).select("example_id")
    return indexing.dense_index(survivors, "example_id", "example_index")


@query
def cleaning_summary(spark: SparkSession, sf: str) -> DataFrame:
    examples = fx.examples(spark, sf)
    return cleaning.cleaning_summary(examples, cleaning.clean_examples(examples))


# ---- split, audit ----------------------------------------------------------------------------------
@query
def split_train(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_train_eval(fx.examples(spark, sf))[0].select("example_id")


@query
def split_eval(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_train_eval(fx.examples(spark, sf))[1].select("example_id")


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.token_counts(fx.load(spark, sf, "fx_pages")).select("doc_id", "page_no", "tokens")


@query
def length_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.length_audit(fx.load(spark, sf, "documents"), F.col("text"))


@query
def training_length_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.length_audit(fx.examples(spark, sf), messages.render_chat(F.col("messages")), limit=100)


# ---- documents -------------------------------------------------------------------------------------
@query
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_pages(fx.load(spark, sf, "fx_pages"), PAGE_BUDGET)


@query
def chunk_pages_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The same result by the way taken for documents of very many pages."""
    return chunking.chunk_pages(fx.load(spark, sf, "fx_pages"), PAGE_BUDGET, block_pages=2, fan_in=2)


@query
def extract_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk, run a model hook and merge; the stand-in model answers with the prompt length."""
    def load() -> Callable:
        return lambda prompts: [json.dumps({"liability_cap": str(len(p))}) for p in prompts]

    chunks = chunking.chunk_pages(fx.load(spark, sf, "fx_pages"), PAGE_BUDGET)
    return merging.merge_chunks(extract(chunks, load)).select("doc_id", *SCALAR_FIELDS)


@query
def extract_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Status per document when the model fails on prompts of certain lengths."""
    def load() -> Callable:
        def model(prompts):
            if any(len(p) % 7 == 0 for p in prompts):
                raise ValueError("bad length")
            return ["{}" for _ in prompts]

        return model

    chunks = chunking.chunk_pages(fx.load(spark, sf, "fx_pages"), PAGE_BUDGET)
    return document_status(extract(chunks, load))


@query
def first_json_object(spark: SparkSession, sf: str) -> DataFrame:
    parsed = fx.load(spark, sf, "fx_chunk_outputs").withColumn("label", jsonx.first_object(F.col("output_text")))
    found = F.col("label")
    return parsed.select(
        "doc_id", "chunk_no", found.isNotNull().alias("found"),
        *[jsonx.stringify(found[f]).alias(f) for f in FIELDS],
    )


@query
def merge_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_chunks(fx.load(spark, sf, "fx_chunk_outputs")).withColumn("parties", _joined("parties"))


@query
def display_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return documents.display_defaults(merging.merge_chunks(fx.load(spark, sf, "fx_chunk_outputs")))


@query
def route_input(spark: SparkSession, sf: str) -> DataFrame:
    id_ = F.col("doc_id")
    kind = F.when(id_ % 3 == 0, "Paste Text").when(id_ % 3 == 1, "Upload PDF").otherwise("Other")
    requests = fx.load(spark, sf, "documents").select(
        "doc_id", kind.alias("input_type"), F.when(id_ % 4 != 0, F.col("text")).otherwise("").alias("text_input"),
        F.when(id_ % 5 != 0, F.col("text")).alias("document_text"),
    )
    return documents.route_input(requests).select("doc_id", "raw_text", "error")


# ---- scoring functions -----------------------------------------------------------------------------
@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query
def normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, "fx_examples").select("example_id", dates.normalize_date(F.col("label_date")).alias("iso"))


@query
def split_parties(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat_ws(" AND ", F.concat_ws("; ", "label_p1", F.lit("")), F.concat_ws(", ", "label_p2", "label_p2"))
    names = F.array_sort(scoring.split_parties(both))
    return fx.load(spark, sf, "fx_examples").select("example_id", _joined(names).alias("parties"))


@query
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    f = "termination_conditions"
    score = scoring.token_f1(F.col(f"pred_{f}"), F.col(f"true_{f}"))
    return _paired(spark, sf).select("model", "example_id", F.round(score, 6).alias("score"))


@query
def party_f1(spark: SparkSession, sf: str) -> DataFrame:
    score = scoring.party_f1(F.col("pred_parties"), F.col("true_parties"))
    return _paired(spark, sf).select("model", "example_id", F.round(score, 6).alias("score"))


@query
def date_match(spark: SparkSession, sf: str) -> DataFrame:
    score = scoring.date_match(F.col("pred_effective_date"), F.col("true_effective_date"))
    return _paired(spark, sf).select("model", "example_id", score.alias("score"))


@query
def field_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("model", "example_id", *[F.round(f"score_{f}", 6).alias(f) for f in FIELDS])


@query
def hallucination(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("model", "example_id", *[F.col(f"hallucinated_{f}").alias(f) for f in FIELDS])


# ---- model outputs ---------------------------------------------------------------------------------
@query
def truncate_repetition(spark: SparkSession, sf: str) -> DataFrame:
    outputs = fx.predictions(spark, sf).withColumn("loop_at", loop_position(F.col("output_text")))
    cut = F.when(F.col("loop_at") >= 0, F.substring(F.col("output_text"), F.lit(1), F.col("loop_at")))
    return outputs.select("model", "example_id", "loop_at", F.coalesce(cut, "output_text").alias("kept_text"))


@query
def close_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every output cut 30 characters before its end and closed again."""
    body = F.substring(F.col("output_text"), F.lit(1), F.length("output_text") - 30)
    closed = fx.predictions(spark, sf).withColumn("closed", jsonx.close_truncated(body))
    label = jsonx.strict_label(F.col("closed"))
    return closed.select("model", "example_id", "closed", jsonx.stringify(label["liability_cap"]).alias("liability_cap"))


@query
def parse_outputs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = evaluation.parse_outputs(fx.predictions(spark, sf))
    return parsed.select(
        "model", "example_id", *[F.col(f"pred_{f}").alias(f) for f in FIELDS], "parse_failed", "was_truncated"
    )


@query
def parse_or_error(spark: SparkSession, sf: str) -> DataFrame:
    parsed = documents.parse_or_error(fx.predictions(spark, sf))
    return parsed.select("model", "example_id", *FIELDS, "error", "raw_output")


@query
def unfence_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).select("model", "example_id", unfence(F.col("output_text")).alias("body"))


@query
def align_predictions(spark: SparkSession, sf: str) -> DataFrame:
    paired = evaluation.align_predictions(fx.predictions(spark, sf), fx.examples(spark, sf))
    return paired.select(
        "model", "example_id", "output_text", messages.first_of_role(F.col("messages"), "user").alias("user_text")
    )


# ---- metrics ---------------------------------------------------------------------------------------
@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.eval_metrics(_scored(spark, sf))


@query
def metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.metrics_by_type(_scored(spark, sf))


@query
def heldout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics on the held-out part of the split only."""
    held_out = split.split_train_eval(fx.examples(spark, sf))[1]
    return evaluation.metrics_by_type(evaluation.score_predictions(fx.predictions(spark, sf), held_out))


@query
def parse_or_error_open(spark: SparkSession, sf: str) -> DataFrame:
    """Demo records with a key of their own, which survives."""
    note = F.concat(F.lit('"note": ["n'), F.col("example_id"), F.lit('"], "termination_conditions"'))
    noted = fx.predictions(spark, sf).withColumn("output_text", F.replace("output_text", F.lit('"termination_conditions"'), note))
    parsed = documents.parse_or_error(noted)
    other = F.col("other_fields")
    return parsed.select(
        "model", "example_id", F.coalesce(F.cardinality(other), F.lit(-1)).alias("n_other"), jsonx.stringify(other["note"]).alias("note"), "liability_cap", "error",
    )


@query
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.evaluation_report(evaluation.metrics_by_type(_scored(spark, sf)), MODELS)


@query
def metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.metrics_table(evaluation.eval_metrics(_scored(spark, sf)), MODELS)


@query
def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.markdown_table(evaluation.eval_metrics(_scored(spark, sf)), MODELS)


@query
def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    return reporting.metrics_json(evaluation.metrics_by_type(_scored(spark, sf)))
