"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, collocations, language, licenses, line_dedup, mixing, pii, quality, simhash, token_counts, weighted_sampling
from .common import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL for the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The near-duplicate contract: words in a shingle, and most differing bits.
SHINGLE, DISTANCE = 4, 4


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(documents(spark, sf_dir), SHINGLE, DISTANCE)
    return grouped.select(F.col("id").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.with_measures(documents(spark, sf_dir).select("doc_id", "text"))
    slim = measured.select("row.doc_id", *quality.MEASURES, *quality.MORE_MEASURES)
    return quality.judge(stage(slim, "quality")).select("doc_id", *quality.MEASURES, "base_failed", "kept", "quality")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language.held_out())
    model = language.fit(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = weighted_sampling.compare_with_next(documents(spark, sf_dir))
    prints = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return compared.withColumns(prints)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find_spans(docs, pii.fit(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: A conversation that holds the template's own control strings.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(TRICKY, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.read_back(chat.format_windows(turns.unionByName(extra))))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return coded.select(
        "doc_id", byte_bpe.n_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(mixing.sized(documents(spark, sf_dir), F.lit(0)), "sizes")
    return mixing.mix(sizes).select(
        F.col("id").alias("doc_id"), "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


@query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("base_spans", lambda s: s["start"])
    labels = F.array_sort(F.array_distinct(F.transform("base_spans", lambda s: s["label"])))
    return found.select(
        "row.doc_id", "n_words", F.size("base_spans").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(documents(spark, sf_dir), *files).withColumnRenamed("id", "doc_id")


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lines = docs.agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).first()[0] or 0
    index = line_dedup.LineIndex.empty(spark, lines).insert(docs)
    kept = line_dedup.drop_repeated_lines(docs, index)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op11_collocations"] = r"""
WITH RECURSIVE texts AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, doc_id, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM lists, range(1, 6) AS sizes(k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM found WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n,
    (1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 : size], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM found q WHERE q.lang = c.lang AND q.k > len(string_split(c.phrase, ' '))
  AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * q.f >= 100 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
ORACLES["op13_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, x AS line, i, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
  LATERAL (SELECT unnest(d.parts) AS x, generate_subscripts(d.parts, 1) AS i) u),
often AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, o.last IS NOT NULL AND o.last <> l.doc_id AS lost FROM lines l LEFT JOIN often o ON o.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
