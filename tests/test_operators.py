"""Operators on small hand-made tables against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from contractspark import schemas, session
from contractspark.functions.messages import chat
from contractspark.operators import (
    audit, candidates, chunking, cleaning, dataset, documents, evaluation, indexing, merging, prefilter, qa, reporting, split,
)
from contractspark.operators.extract import document_status, extract, run_halving
from contractspark.rules import RuleSet
from contractspark.sources import payload, publish, tables
from contractspark.streaming import ingest

N = "Not Specified"


def spaced_tokens(text):
    """Token counter of the tests: number of blanks, so that a page may have none."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def page(blanks, mark="z"):
    """A page of so many tokens."""
    return "w " * blanks + mark


@pytest.mark.parametrize("block_pages,fan_in", [(4096, 512), (4, 3), (2, 2)])
def test_chunk_pages_finds_the_chunks_that_were_cut(spark, block_pages, fan_in):
    """Chosen chunks that fill the budget, or hold one page beyond it, are cut into pages and must come back."""
    chance, budget, rows, want = random.Random(3), 7, [], set()
    for doc in range(12):
        chunks = []
        for _ in range(chance.randint(1, 12)):
            if chance.random() < 0.2:
                chunks.append([budget + chance.randint(1, 9)])
            else:
                cuts = sorted(chance.sample(range(1, budget), chance.randint(0, 4)))
                chunks.append([b - a for a, b in zip([0, *cuts], [*cuts, budget])])
        number = 0
        for n, sizes in enumerate(chunks, 1):
            pages = [page(k, f"z{doc}.{number + i}") for i, k in enumerate(sizes)]
            rows += [(doc, number + i, p) for i, p in enumerate(pages)]
            number += len(sizes)
            want.add((doc, n, "\n\n".join(pages)))
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, schemas.PAGE).repartition(3)
    got = chunking.chunk_pages(df, budget, spaced_tokens, block_pages, fan_in).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block_pages,fan_in", [(4096, 512), (2, 2)])
def test_chunk_pages_literal_cases(spark, block_pages, fan_in):
    docs = {1: ["a b c d e f g h i"], 2: ["a b", "c d", "e f", ""], 3: ["", " ", ""], 4: ["a b c d e f", "", "x y"]}
    df = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in enumerate(ps)], schemas.PAGE)
    got = {tuple(r) for r in chunking.chunk_pages(df, 4, spaced_tokens, block_pages, fan_in).collect()}
    assert got == {(1, 1, "a b c d e f g h i"), (2, 1, "a b\n\nc d\n\ne f"), (4, 1, "a b c d e f"), (4, 2, "x y")}


def test_odd_page_numbers_give_one_result_either_way(spark):
    numbers = [None, -5, 0, 2, 3, 9, 1000, None]
    rows = [(d, n, page(1 + i, f"p{i}")) for d in (1, 2) for i, n in enumerate(numbers)] + [(3, None, "only"), (4, 1, None)]
    df = spark.createDataFrame(rows, schemas.PAGE).repartition(3)
    shapes = [
        (sorted(map(tuple, chunking.chunk_pages(df, 6, spaced_tokens, b, 2).collect())), sorted(map(tuple, documents.doc_text(df, 60, b).select("doc_id", "text").collect())))
        for b in (2, 5, 4096)
    ]
    assert shapes[0] == shapes[1] == shapes[2]
    words = " ".join(t for d, _, t in shapes[0][0] if d == 1)
    assert [words.index(f"p{i}") for i in (0, 7, 1, 2, 3, 4, 5, 6)] == sorted(words.index(f"p{i}") for i in range(8))
    assert (3, 1, "only") in shapes[0][0]


@pytest.mark.parametrize("block_pages", [4096, 3])
def test_doc_text(spark, block_pages):
    docs = {1: ["ab"], 2: ["x" * 7, "", "y" * 9], 3: [f"p{i}" for i in range(40)], 4: [None, "q"]}
    df = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in enumerate(ps)], schemas.PAGE)
    got = dict(documents.doc_text(df, 12, block_pages).select("doc_id", "text").collect())
    assert got == {d: "".join((t or "") + "\n" for t in ps)[:12] for d, ps in docs.items()}


def test_qa_to_contracts_gathers_what_was_scattered(spark):
    """Chosen contracts, one of them hot, are scattered over rows in order; later answers to a question win."""
    chance, rows, want = random.Random(5), [], {}
    ask = {"effective_date": "the EFFECTIVE DATE", "liability_cap": "liability cap", "termination_conditions": "may terminate"}
    for c in range(25):
        context = f"contract text number {c:03d} " + "x" * (c % 9)
        names = [f"A{c}.{i}" for i in range(chance.randint(0, 4))]
        last = {f: chance.choice([N, f"{f} {c}"]) for f in ask}
        said = [("Parties?", f" {n} ") for n in names] + [("other", f"noise {c}"), ("Parties?", None)]
        for field, value in last.items():
            if value != N:
                said += [(ask[field], "an earlier answer"), (ask[field], f"{value}\n")]
            said.append((ask[field], chance.choice([None, N])))
        said += [("Parties?", n) for n in names[:1]] * (300 if c == 8 else 1)
        rows += [(len(rows) + i, context, q, [] if a is None else [a, "zz"]) for i, (q, a) in enumerate(said)]
        if names or last["effective_date"] != N:
            want[context] = ("|".join(names or [N]), *last.values())
    chance.shuffle(rows)
    df = spark.createDataFrame([(i, c, q, (a,)) for i, c, q, a in rows], schemas.QA_ROW).repartition(5)
    got = qa.qa_to_contracts(df, 3500).collect()
    assert {r.context: ("|".join(r.parties), r.effective_date, r.liability_cap, r.termination_conditions) for r in got} == want
    cut = qa.qa_to_contracts(df, 20).collect()  # all contexts agree so far, but for the number
    assert {r.context for r in cut} <= {"contract text number..."} and len(cut) == 1


def test_texts_of_other_rows_are_left_out_before_the_join(spark):
    """Every wanted row passes the bitmap and few others do, so their texts are not shuffled."""
    keys = spark.range(0, 100_000, 50).selectExpr("id AS k").unionByName(spark.createDataFrame([(None,), (-7,)], "k long"))
    rows = spark.range(-10, 100_000).selectExpr("id AS k", "'text' AS t").unionByName(spark.createDataFrame([(None, "t")], "k long, t string"))
    kept = prefilter.perhaps_among(rows, keys, "k")
    assert kept.join(keys, "k", "left_semi").count() == 2001 and kept.count() < 12_000 and kept.columns == ["k", "t"]
    assert prefilter.perhaps_among(rows, keys.limit(0), "k").count() == 0
    answers = spark.createDataFrame([(i, f"context {i % 3}", "Parties?", (["A"],)) for i in range(9)], schemas.QA_ROW)
    plan = qa.qa_to_contracts(answers)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bitmap" in plan


def test_question_answer_files_hold_a_repeated_context_once(spark, tmp_path):
    noise = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000))
    rows = [(i, noise, f"question {i}", (["a"],)) for i in range(8)]
    tables.write_qa(spark.createDataFrame(rows, schemas.QA_ROW).coalesce(1), str(tmp_path / "qa"))
    assert sum(f.stat().st_size for f in (tmp_path / "qa").glob("*.parquet")) < 200_000
    assert sorted(map(tuple, tables.read_qa(spark, str(tmp_path / "qa"), "part-*").select("row_id", "context").collect())) == [r[:2] for r in rows]


def test_a_context_longer_than_the_codecs_window_is_written_once(spark, tmp_path):
    """Of six rows of 3 MB one is stored whole; short and absent contexts, and more answers than a dictionary holds, come back too."""
    text = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3_000_000))
    long = [(i, text, f"question {i}", (["a"] * (i % 3),)) for i in range(6)]
    tables.write_qa(spark.createDataFrame(long, schemas.QA_ROW).coalesce(1), str(tmp_path / "long"))
    assert sum(f.stat().st_size for f in (tmp_path / "long").glob("*.parquet")) < 3_000_000
    short = [(i, None if i % 7 == 0 else f"Agreement {i // 5}. " + "ü" * (i % 90), "q", ([f"{i:0150d}", ""],)) for i in range(6, 10_000)]
    tables.write_qa(spark.createDataFrame(short, schemas.QA_ROW).coalesce(1), str(tmp_path / "short"))
    got = [r for part in ("long", "short") for r in tables.read_qa(spark, str(tmp_path / part), "part-*").collect()]
    assert sorted((r.row_id, r.context, r.question, (r.answers.text,)) for r in got) == long + short


def test_merge_chunks_gathers_what_was_scattered(spark):
    """Chosen records are spread over chunks, with defaults, repeats and junk between; one document is hot."""
    chance, rows, want = random.Random(9), [], {}
    for doc in range(40):
        names = [f"P{doc}.{i}" for i in range(chance.randint(0, 5))]
        record = {k: chance.choice([N, None, "", f"{k} {doc}"]) for k in ("effective_date", "liability_cap", "termination_conditions")}
        chunks = [{"parties": [n, N]} for n in names] + [{"parties": [n]} for n in names[:1]] * (400 if doc == 0 else 2)
        for key, value in record.items():
            if value != N:
                chunks.append({key: value})
                chunks += [{key: "a later value"}, {key: N}]
        texts = ["so " + json.dumps(c) + " end" for c in [{}, *chunks]] + ["nothing"]
        rows += [(doc, n, t) for n, t in enumerate(texts)]
        want[doc] = {"parties": names, **record}
    chance.shuffle(rows)
    got = merging.merge_chunks(spark.createDataFrame(rows, schemas.CHUNK_OUTPUT).repartition(4)).collect()
    assert {r.doc_id: {k: r[k] for k in want[0]} for r in got} == want


def test_merge_keeps_order_beyond_any_position(spark):
    long = json.dumps({"parties": [f"p{i}" for i in range(3)]})
    rows = [(1, 2**50, long), (1, 2**50 + 1, json.dumps({"parties": ["q", "p1"]}))]
    assert merging.merge_chunks(spark.createDataFrame(rows, schemas.CHUNK_OUTPUT)).first().parties == ["p0", "p1", "p2", "q"]


@pytest.mark.parametrize("ids", [range(50), [2**40 + 5, 3, 2**21, 2**21 + 1, 0, 2**62], [-5, 7, -(2**45), 2**20, 2**20 - 1]])
def test_dense_index(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    got = dict(indexing.dense_index(df, "id", "n").select("id", "n").collect())
    assert got == {v: n for n, v in enumerate(sorted(ids))}


@pytest.mark.parametrize("n", [1, 2, 6, 7, 1000])
def test_split_sizes_are_exact_and_disjoint(spark, n):
    df = spark.range(n).withColumnRenamed("id", "example_id")
    train, held_out = split.split_train_eval(df, 0.15, 42)
    a, b = ({r[0] for r in part.collect()} for part in (train, held_out))
    assert len(b) == max(1, int(n * 0.15)) and not a & b and len(a | b) == n
    again = split.split_train_eval(df.repartition(7), 0.15, 42)[1]
    assert {r[0] for r in again.collect()} == b


@pytest.mark.parametrize("lengths", [[3], [4, 1, 3, 2], list(range(1, 21)), [5] * 7 + [9]])
def test_length_audit(spark, lengths):
    df = spark.createDataFrame([(" ".join("w" * k),) for k in lengths], "text string").repartition(3)
    row = audit.length_audit(df, F.col("text"), limit=3).first()
    s, n = sorted(lengths), len(lengths)
    assert tuple(row) == (n, s[n // 2], s[int(n * 0.95)], s[-1], sum(v > 3 for v in s))


def candidate(text="Deal of Acme on 2024", **fields):
    return json.dumps({"messy_text": text, "parties": ["Acme"], "effective_date": "2024", "liability_cap": N, **fields})


def test_candidate_lists_of_mixed_entries(spark):
    """Null entries count as null-like, numbers and nested values by their text; a key given twice counts last."""
    twice = candidate()[:-1] + ', "messy_text": "Deal of Acme on 2024, again"}'
    cases = [
        (candidate(parties=["Acme", None]), None), (candidate(parties=[None]), None), (candidate(parties=[2024]), None),
        (candidate(parties=[7, "Acme"]), "party"), (candidate(parties=[["Acme"]]), "party"),
        (candidate(parties={"a": 1}), "parties_type"), (candidate(parties=3), "parties_type"),
        (candidate(parties=["ACME "], effective_date=2024), None), (twice, None), (None, "bad_json"), ("", "bad_json"),
    ]
    df = spark.createDataFrame([(i, 0, c) for i, (c, _) in enumerate(cases)], "example_id long, attempt int, raw_content string")
    reasons = {r.example_id: r.reason for r in candidates.validate_candidates(df).collect()}
    assert reasons == {i: reason for i, (_, reason) in enumerate(cases)}
    kept = {r.example_id: r.messages for r in candidates.first_valid_attempt(df).collect()}
    assert sorted(kept) == [i for i, (_, reason) in enumerate(cases) if reason is None]
    assert kept[8][-2].content.endswith("Deal of Acme on 2024, again") and "messy_text" not in kept[8][-1].content


def test_candidate_validation_and_first_attempt(spark):
    rows = [
        (1, 0, candidate(parties=["Zed"])), (1, 1, candidate(extra={"k": [1]})), (1, 2, candidate()),
        (2, 0, "[1]"), (2, 5, candidate()), (3, 0, candidate(parties=None)), (3, 1, candidate(effective_date="May 9")),
        (3, 2, candidate(liability_cap="USD 7")), (3, 3, candidate(text=None)), (3, 4, candidate(text=None, parties=[], effective_date="")),
        (4, 0, candidate(text="", parties=[], effective_date="none", liability_cap=None)),
    ]
    df = spark.createDataFrame(rows, schemas.CANDIDATE)
    reasons = {(r.example_id, r.attempt): r.reason for r in candidates.validate_candidates(df).collect()}
    assert reasons == {
        (1, 0): "party", (1, 1): None, (1, 2): None, (2, 0): "bad_json", (2, 5): None, (3, 0): "parties_type",
        (3, 1): "effective_date", (3, 2): "liability_cap", (3, 3): "party", (3, 4): "no_messy_text", (4, 0): None,
    }
    kept = {r.example_id: r for r in candidates.first_valid_attempt(df).collect()}
    assert {k: r.attempt for k, r in kept.items()} == {1: 1, 4: 0}
    answer = json.loads(kept[1].messages[2].content)
    assert answer == {"parties": ["Acme"], "effective_date": "2024", "liability_cap": N, "extra": {"k": [1]}}


def test_clean_examples_keeps_unknown_keys_and_untouched_text(spark):
    odd = '{"parties":  [" Acme "],"effective_date":"renewal","x":1.50}'
    rows = [(1, odd), (2, json.dumps({"parties": ["We shall pay", "B Inc"], "more": [1, {"z": None}]})), (3, "{}"), (4, "bad"), (5, '{"other": 1}')]
    df = spark.createDataFrame(rows, "example_id bigint, a string").select("example_id", chat(F.lit("u"), F.col("a")).alias("messages"))
    got = {r.example_id: r for r in cleaning.clean_examples(df).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1].messages[2].content == odd and got[1].effective_date_flagged and not got[1].modified
    assert json.loads(got[2].messages[2].content) == {"parties": ["B Inc"], "more": [1, {"z": None}]}
    assert got[2].parties_dropped == ["We shall pay"]
    summary = cleaning.cleaning_summary(df, cleaning.clean_examples(df)).first()
    assert tuple(summary) == (3, 1, 1, 0, 1, 2)


def test_metrics_of_a_type_without_examples_are_zero(spark):
    label = json.dumps({"parties": ["A"], "effective_date": "2024-01-02", "liability_cap": "x", "termination_conditions": "y"})
    examples = spark.createDataFrame([(1, "A on 2024-01-02 x y", label)], "example_id bigint, u string, a string").select(
        "example_id", chat(F.col("u"), F.col("a")).alias("messages"))
    outputs = spark.createDataFrame([("m", 1, label), ("m", 2, label), ("n", 1, "junk")], schemas.PREDICTION)
    got = {(r.model, r.scope): r for r in evaluation.metrics_by_type(evaluation.score_predictions(outputs, examples)).collect()}
    assert len(got) == 6
    good, empty, bad = got["m", "overall"], got["m", "real_world_sec_style"], got["n", "templated_synthetic"]
    assert (good.n, good.overall_f1, good.exact_match_rate) == (1, 100.0, 100.0)
    assert (empty.n, empty.overall_f1, empty.hallucination_rate_on_populated_fields) == (0, 0.0, 0.0)
    assert (bad.n, bad.overall_f1, bad.json_parse_failure_rate) == (1, 0.0, 100.0)


def test_claims_are_looked_up_in_their_normal_form(spark):
    """A date's and a list's keys differ from their normal forms; null-like claims are none, also with blanks around."""
    fields = ("parties", "effective_date", "liability_cap", "termination_conditions")
    labels = [
        (["Acme Inc", "Zed"], "March 3, 2020", "USD 5", "thirty days"), (["Quorum"], "May 7, 1999", "EUR 77", "N/A "),
        (" Not Specified ", "not specified", " n/a", ""),
    ]
    texts = [json.dumps(dict(zip(fields, label))) for label in labels]
    examples = spark.createDataFrame(
        [(i, "Acme Inc Zed, March 3, 2020. USD 5 thirty days", t) for i, t in enumerate(texts)], "example_id bigint, u string, a string"
    ).select("example_id", chat(F.col("u"), F.col("a")).alias("messages"))
    outputs = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], schemas.PREDICTION)
    got = {r.example_id: r for r in evaluation.score_predictions(outputs, examples).collect()}
    assert [[got[i][f"hallucinated_{f}"] for f in fields] for i in range(3)] == [[False] * 4, [True] * 3 + [False], [False] * 4]
    assert [[got[i][f"populated_{f}"] for f in fields] for i in range(3)] == [[True] * 4, [True] * 3 + [False], [False] * 4]


def test_failed_repair_still_counts_as_truncated(spark):
    loop = "no braces here, " + "the same clause once and " * 6 + "."
    row = evaluation.parse_outputs(spark.createDataFrame([("m", 1, loop)], schemas.PREDICTION)).first()
    assert row.parse_failed and row.was_truncated and row.pred_parties == ""


def test_extract_hook_isolates_failing_rows(spark):
    def load():
        def model(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("model failure")
            return [f"{p.count('word')}" for p in prompts]
        return model

    df = spark.createDataFrame([(1, "word word"), (2, "boom"), (3, "word")], "id bigint, chunk_text string").coalesce(1)
    assert {r.id: r.output_text for r in extract(df, load).collect()} == {1: "2", 2: None, 3: "1"}


def test_a_failing_batch_is_halved():
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if "bad" in prompts or "short" in prompts:
            return prompts[1:] if "short" in prompts else 1 / 0
        return [p.upper() for p in prompts]

    prompts = ["a"] * 100 + ["bad"] + ["b"] * 300 + ["short"] + ["c"] * 110
    rows = run_halving(model, prompts)
    assert [r[0] for r in rows] == [p.upper() if len(p) == 1 else None for p in prompts]
    assert {r[2] for r in rows} == {None, "ZeroDivisionError: division by zero", "ValueError: the model returned 0 outputs for 1 prompts"}
    assert len(calls) < 45 and all((r[1] == "failed") == (r[0] is None) for r in rows)
    assert run_halving(model, []) == []


def test_document_status_and_broken_models(spark):
    def load():
        return lambda prompts: ["x" if "boom" not in p else 1 / 0 for p in prompts]

    chunks = [(1, 0, "a"), (1, 1, "boom"), (2, 0, "boom"), (3, 0, None), (None, 0, "a")]
    df = spark.createDataFrame(chunks, "doc_id bigint, chunk_no bigint, chunk_text string")
    got = {r.doc_id: (r.n_chunks, r.n_failed, r.status) for r in document_status(extract(df, load)).collect()}
    assert got[1] == (2, 1, "partial") and got[2] == (1, 1, "failed") and got[None] == (1, 0, "ok")

    def broken():
        raise RuntimeError("no weights")

    with pytest.raises(Exception, match="no weights"):
        extract(df, broken).collect()


def test_carve_payload_bytes(spark):
    """Chosen payloads wrapped in noise, plain and in base64."""
    whole = [b"%PDF-1\x80\xfe%%EOF", b"%PDF-a%%EOF%%EOF", b"%PDF-\n\xe9 open", b"%PDF-"]
    want = dict(enumerate([*whole, *whole[:2], None, None, b""]))
    bodies = [*whole, b"\x00\xff" + whole[0] + b"\xff", b"head" + whole[1] + b"z", b"none", b"", b"%%EOF %PDF-x"]
    df = spark.createDataFrame([(i, bytearray(b), False) for i, b in enumerate(bodies)], "i int, body binary, is_base64 boolean")
    both = df.unionByName(df.select((F.col("i") + 100).alias("i"), F.base64("body").cast("binary").alias("body"), F.lit(True).alias("is_base64")))
    got = {r.i: None if r.payload is None else bytes(r.payload) for r in payload.carve_payload(both).collect()}
    assert got == want | {i + 100: v for i, v in want.items()}


def test_files_without_ids_lose_no_rows(spark, tmp_path):
    """The layout of one ``messages`` per line, with other keys beside it and without ids."""
    lines = [
        {"messages": [{"role": "user", "content": f"u{i}"}, {"role": "assistant", "content": json.dumps({"parties": ["We shall pay", f"B{i}"]})}], "note": {"k": i}}
        for i in range(40)
    ]
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines[part::2]), encoding="utf-8")
    examples = tables.read_examples(spark, str(tmp_path / "in"))
    ids = [r.example_id for r in examples.collect()]
    assert len(set(ids)) == 40 and None not in ids
    train, held_out = split.split_train_eval(examples, 0.15, 42)
    assert (train.count(), held_out.count()) == (34, 6)
    tables.write_cleaned(tables.read_open_examples(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "report"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(w["note"]["k"] for w in written) == list(range(40)) and {frozenset(w) for w in written} == {frozenset({"messages", "note"})}
    assert "We shall pay" not in json.dumps(written)
    report = spark.read.json(str(tmp_path / "report")).collect()
    assert sorted(r.example_index for r in report) == list(range(40))


def test_null_and_repeated_ids_are_kept(spark):
    df = spark.createDataFrame([(i,) for i in [None, 1, 2, 3, None, 3, 4, 5, 6, 7]], "example_id bigint")
    train, held_out = split.split_train_eval(df, 0.3, 1)
    assert train.count() + held_out.count() == 10 and held_out.where("example_id IS NULL").count() == 0
    got = indexing.dense_index(df, "example_id", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(10)) and [r.example_id for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, None, None]


def test_mixed_ids_are_unique_and_types_are_all_counted(spark):
    rows = lambda: spark.createDataFrame([(i,) for i in range(5)], "example_id bigint").select("example_id", chat(F.lit("u"), F.lit("{}")).alias("messages"))
    mixed = qa.mix_datasets(rows(), rows()).collect()
    assert len({r.example_id for r in mixed}) == 10 and {(r.source, r.source_id) for r in mixed} == {(s, i) for s in ("synthetic", "real") for i in range(5)}
    counts = {r.doc_type: r.n for r in evaluation.doc_type_counts(rows()).collect()}
    assert sorted(counts.values()) == [0, 5] and {r.n for r in evaluation.doc_type_counts(rows().limit(0)).collect()} == {0}


def test_jsonl_bad_lines(spark, tmp_path):
    good = json.dumps({"example_id": 1, "messages": [{"role": "user", "content": "ü"}], "note": {"k": 1}})
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n  \nnot json\n", encoding="utf-8")
    rows = tables.read_examples(spark, str(tmp_path), quarantine=True).collect()
    assert {(r.example_id == 1, r.reason, r._corrupt_record) for r in rows} == {(True, None, None), (False, "not_json", "not json")}
    with pytest.raises(Exception):
        tables.read_examples(spark, str(tmp_path)).collect()
    (tmp_path / "a.jsonl").write_text(good + "\n", encoding="utf-8")
    kept = tables.read_open_examples(spark, str(tmp_path)).first()
    assert kept.messages[0].content == "ü" and set(kept.fields) == {"example_id", "note"} and kept.example_id == 1


def test_row_ids_follow_file_order(spark, tmp_path):
    for name, first in (("train-00001.parquet", 100), ("train-00000.parquet", 0), ("test-00000.parquet", 900)):
        rows = [(f"c{first + i}", "q", (["a"],)) for i in range(20)]
        frame = spark.createDataFrame(rows, "context string, question string, answers struct<text:array<string>>").toPandas()
        frame["answers"] = [{"text": list(a["text"])} for a in frame["answers"]]
        frame.to_parquet(tmp_path / name)
    got = [r.context for r in tables.read_qa(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got == [f"c{i}" for i in (*range(20), *range(100, 120))]


def test_write_cleaned_outputs(spark, tmp_path):
    rows = [(i, json.dumps({"parties": ["We shall pay", f"B{i}"] if i % 2 else [f"B{i}"]})) for i in range(10)]
    df = spark.createDataFrame(rows, "example_id bigint, a string").select("example_id", chat(F.lit("u"), F.col("a")).alias("messages"))
    tables.write_cleaned(df, str(tmp_path / "cleaned"), str(tmp_path / "report"))
    assert tables.read_examples(spark, str(tmp_path / "cleaned")).count() == 10
    report = spark.read.json(str(tmp_path / "report")).collect()
    assert {r.example_index for r in report} == {1, 3, 5, 7, 9}


def test_read_pdfs_and_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1%%EOF")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [bytes(r.content) for r in payload.read_pdfs(spark, str(tmp_path)).collect()] == [b"%PDF-1%%EOF"]
    uploads = spark.createDataFrame([("application/pdf",), ("text/plain",), (None,)], "mime_type string")
    assert payload.accept_uploads(uploads).count() == 1


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    rows = [(i, a, candidate() if (i + a) % 3 == 0 else candidate(parties=["Zed"])) for i in range(30) for a in range(3)]
    df = spark.createDataFrame(rows, schemas.CANDIDATE)
    inbox, accepted, state = (str(tmp_path / p) for p in ("in", "accepted", "state"))
    df.where("example_id < 20").coalesce(1).write.json(inbox)
    run = lambda: ingest.ingest_candidates(ingest.read_candidates(spark, inbox, 1), accepted, state).awaitTermination()
    run()
    # a second delivery repeats known examples and brings new ones
    df.where("example_id >= 10").coalesce(1).write.mode("append").json(inbox)
    run()
    run()
    want = cleaning.clean_examples(candidates.first_valid_attempt(df)).select("example_id", "attempt", "messages")
    got = spark.read.parquet(accepted).select("example_id", "attempt", "messages")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_settles_ids_in_its_state(spark, tmp_path):
    """A later batch doesn't read what was written before, and a replayed one writes each example once."""
    inbox, accepted, state = (tmp_path / p for p in ("in", "accepted", "state"))
    rows = [(i, a, candidate() if a else candidate(parties=["Zed"])) for i in range(9) for a in range(3)] + [(None, 1, candidate()), (None, 2, candidate())]
    df = spark.createDataFrame(rows, schemas.CANDIDATE)
    run = lambda: ingest.ingest_candidates(ingest.read_candidates(spark, str(inbox), 1), str(accepted), str(state)).awaitTermination()
    df.where("example_id < 6 AND attempt < 2").coalesce(1).write.json(str(inbox))
    run()
    first = {f: f.read_bytes() for f in accepted.glob("*.parquet")}
    for f in first:
        f.write_bytes(b"unreadable")
    df.coalesce(1).write.mode("append").json(str(inbox))
    run()
    for f, content in first.items():
        f.write_bytes(content)
    got = lambda: sorted(map(str, spark.read.parquet(str(accepted)).select("example_id", "attempt").collect()))
    want = sorted(map(str, spark.createDataFrame([(i, 1) for i in [*range(9), None]], "example_id long, attempt int").collect()))
    assert got() == want
    last = max((state / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, state / "commits" / f".{last.name}.crc"):
        f.unlink(missing_ok=True)  # as if the job had died between writing and committing
    run()
    assert got() == want


def test_stream_settles_many_ids_without_a_python_call_for_each(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("example_id"), F.explode(F.lit([2, 0, 1])).alias("attempt"), F.lit(candidate()).alias("raw_content"))
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = ingest.read_candidates(spark, str(tmp_path / "in"), 1)
    plan = ingest.accepted_candidates(stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "FlatMapGroupsInPandasWithState" not in plan
    ingest.ingest_candidates(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3000 and got.where("attempt <> 0").isEmpty()


def test_bad_lines_stop_the_open_reader_or_get_a_reason(spark, tmp_path):
    message = '{"role": "user", "content": "x"}'
    lines = {
        f'{{"example_id": 1, "messages": [{message}], "k": [1]}}': None, f'{{"messages": [{message}]}}': None, '{"messages": null, "example_id": null}': None,
        f'{{"messages": [{message}]': "not_json", f'{{"messages": [{message}]}} x': "not_json", "5": "not_object", "not": "not_json", "[{}]": "not_object",
        '{"messages": {"role": "user"}}': "messages", '{"messages": [1]}': "messages", '{"example_id": 1.5}': "example_id", '{"example_id": [2]}': "example_id",
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n \n".join(lines) + "\n\t\n")
    rows = tables.read_open_examples(spark, str(tmp_path / "in"), quarantine=True).collect()
    assert {r["_corrupt_record"]: r.reason for r in rows if r.reason} == {k: v for k, v in lines.items() if v}
    assert len({r.example_id for r in rows}) == len(rows) == len(lines) and all(r.example_id is not None for r in rows)
    assert {r.example_id for r in tables.read_examples(spark, str(tmp_path / "in"), quarantine=True).collect()} == {r.example_id for r in rows}
    with pytest.raises(Exception, match="bad line"):
        tables.read_open_examples(spark, str(tmp_path / "in")).select("example_id").collect()
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.jsonl").write_text("\n".join(k for k, v in lines.items() if not v))
    assert tables.read_open_examples(spark, str(tmp_path / "good")).count() == 3


def test_outputs_never_replace_inputs(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, [("assistant", '{"parties": []}')])], schemas.EXAMPLE).write.json(source)
    for out in (source, f"{source}/", str(tmp_path)):
        with pytest.raises(ValueError, match="input"):
            tables.write_cleaned(tables.read_examples(spark, source), out, str(tmp_path / "report"))
    assert tables.read_examples(spark, source).count() == 1


def _listing(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if not p.name.endswith(".crc"))


def test_index_keeps_rows_by_place_where_they_are_and_evaluates_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(0, 400, 1, 4).select(((F.lit(9) - F.spark_partition_id()).cast("bigint") * (1 << 33) + F.col("id")).alias("id"))
    got = indexing.dense_index(df.where("id % 3 = 0").mapInPandas(count, "id bigint"), "id", "n", str(tmp_path / "a"))
    rows = got.collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.id)] == list(range(len(rows))) and seen.value == len(rows) > 100
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["placed", "runs"]  # nothing was dealt anew
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()


def test_index_of_overlapping_runs_null_and_equal_ids(spark, tmp_path):
    ids = [None] * 50 + [7] * 60 + list(range(-20, 40))
    random.Random(5).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = indexing.dense_index(df, "id", "n", str(tmp_path / "b")).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(ids)))
    assert [r.id for r in got] == sorted(i for i in ids if i is not None) + [None] * 50
    assert (tmp_path / "b" / "dealt").exists()
    empty = indexing.dense_index(df.where("id > 99"), "id", "n")
    assert empty.count() == 0 and empty.columns == ["id", "n"]


def test_outputs_are_published_together(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "deep" / "two")
    rows = lambda n: lambda path: spark.range(n).write.json(path)
    sizes = lambda: [spark.read.schema("id bigint").json(p).count() for p in (one, two)]

    def fail(path):
        spark.range(1).write.json(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        publish.publish(spark, {one: rows(3), two: fail})
    assert _listing(tmp_path) in ([], ["deep"])
    publish.publish(spark, {one: rows(3), two: rows(4)})
    assert sizes() == [3, 4]
    with pytest.raises(RuntimeError, match="lost"):
        publish.publish(spark, {one: rows(5), two: fail})
    assert sizes() == [3, 4]
    publish.publish(spark, {one: rows(5), two: rows(6)})
    assert sizes() == [5, 6] and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["deep", "one"]
    assert not publish.finish(spark, one)


def test_a_job_lost_between_the_moves_is_finished(spark, tmp_path, monkeypatch):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    rows = lambda n: lambda path: spark.range(n).write.json(path)
    publish.publish(spark, {one: rows(1), two: rows(2)})
    moves = []

    def moved(done, path):
        moves.append(str(path))
        if len(moves) == 4:  # the manifest, both moves of the first output, then the old second one
            raise OSError("lost")

    monkeypatch.setattr(publish, "_moved", moved)
    with pytest.raises(OSError, match="lost"):
        publish.publish(spark, {one: rows(7), two: rows(8)})
    monkeypatch.undo()
    assert not (tmp_path / "two").exists()
    assert publish.finish(spark, one)
    assert [spark.read.schema("id bigint").json(p).count() for p in (one, two)] == [7, 8]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["one", "two"]


def test_a_failed_cleaning_leaves_outputs_and_no_staging(spark, tmp_path, monkeypatch):
    base = tmp_path / "shared"
    monkeypatch.setattr(tables, "shared_folder", lambda *_: str(base / "cleaned"))
    rows = [(1, [("assistant", '{"parties": ["Acme LLC", "We shall pay"]}')])]
    df = spark.createDataFrame(rows, schemas.EXAMPLE)
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    tables.write_cleaned(df, out, report)
    first = _listing(tmp_path / "out"), _listing(tmp_path / "report")
    assert not list(base.iterdir())

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "cleaning_report", fail)
    with pytest.raises(RuntimeError, match="lost"):
        tables.write_cleaned(df, out, report)
    assert (_listing(tmp_path / "out"), _listing(tmp_path / "report")) == first
    assert not list(base.iterdir())


def test_staging_has_a_folder_where_the_session_names_none():
    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local[2]"
            getConf = staticmethod(dict)

    one, two = (session.shared_folder(Unset, "x") for _ in range(2))
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    Unset.sparkContext.master = "spark://host"
    with pytest.raises(RuntimeError, match="shared"):
        session.shared_folder(Unset, "x")


def test_report_shows_what_the_metrics_lack(spark):
    rows = [("overall", "a", 4, 12.5), ("overall", "b", 4, 0.0), ("templated_synthetic", "a", 4, 100.0)]
    metrics = spark.createDataFrame(rows, "scope string, model string, n long, v double")
    metrics = metrics.select("scope", "model", "n", *[F.col("v").alias(m) for m in evaluation.METRICS])
    lines = [r.line for r in reporting.evaluation_report(metrics, ["a", "b"]).orderBy("position").collect()]
    assert lines[:4] == ["", "### Overall Model Evaluation Results (blended) (n=4)", "| Metric | a | b |", "|--------|---|---|"]
    assert "| **Exact Match Rate** | 12.5% | 0.0% |" in lines and "| `parties` | 100.0% | ?% |" in lines
    assert lines[-1] == "Document type breakdown in held-out set: {'templated_synthetic': 4, 'real_world_sec_style': ?}"
    assert lines.count("") == 7 and sum(line.startswith("#### ") for line in lines) == 3


def test_demo_record_keeps_unknown_keys(spark):
    texts = ['```json\n{"parties": ["A"], "note": {"k": [1]}, "n": null}```', "{}", "no", None]
    rows = documents.parse_or_error(spark.createDataFrame(list(enumerate(texts)), "i int, output_text string"))
    got = [r[0] for r in rows.orderBy("i").select(F.to_json("other_fields")).collect()]
    assert [json.loads(g) if g else g for g in got] == [{"note": {"k": [1]}, "n": None}, {}, None, None]
    assert [r.error is None for r in rows.orderBy("i").collect()] == [True, True, False, False]


def test_hybrid_dataset_cleans_splits_and_loses_nothing(spark, tmp_path):
    label = lambda n: json.dumps({"parties": ["Acme LLC", "We shall pay"] if n % 2 else ["Acme LLC"], "effective_date": "N"}) if n % 5 else "{}"
    synthetic = spark.createDataFrame([(n, [("user", "u"), ("assistant", label(n))]) for n in range(40)], schemas.EXAMPLE)
    asked = [(5 * c + k, f"text {c}", q, (["P"],)) for c in range(9) for k, q in enumerate(["Parties", "Effective Date"])]
    qa_rows = spark.createDataFrame(asked, schemas.QA_ROW)
    train, held_out = dataset.hybrid_dataset(synthetic, qa_rows, str(tmp_path / "mix"), 0.25, 3)
    a, b = train.collect(), held_out.collect()
    assert len(a) + len(b) == 32 + 9 and len(b) == 10
    assert {(r.source, r.source_id) for r in a + b} == {("synthetic", n) for n in range(40) if n % 5} | {("real", 5 * c) for c in range(9)}
    assert {r.source_id for r in a + b if r.modified} == {n for n in range(40) if n % 5 and n % 2}
    assert "We shall pay" not in str([r.messages for r in a + b])
    none = dataset.hybrid_dataset(synthetic.limit(0), qa_rows.limit(0), str(tmp_path / "none"))
    assert [p.count() for p in none] == [0, 0]
    prompts = {r.example_id: r.prompt for r in dataset.evaluation_prompts(held_out).collect()}
    assert len(prompts) == 10 and all("assistant" in p and "Acme" not in p for p in prompts.values())


@pytest.mark.parametrize("near", [0, 128, 70_000])
def test_split_cut_in_one_pass_or_two(spark, monkeypatch, near):
    monkeypatch.setattr(split, "NEAR_BUCKETS", near)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(3000).withColumnRenamed("id", "example_id").mapInPandas(count, "example_id bigint")
    cut = split._cutoff(df, 0.15, 42, "example_id")
    digests = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(3000))
    assert cut == digests[449]
    assert near != 70_000 or seen.value == 3000  # the input was evaluated once
    assert split._cutoff(df.where("example_id < 0"), 0.15, 42, "example_id") is None


def test_split_of_an_id_on_most_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(7)).otherwise(F.col("id")).alias("example_id"))
    train, held_out = (p.groupBy("example_id").count().collect() for p in split.split_train_eval(df, 0.15, 42))
    assert sum(r["count"] for r in train + held_out) == 1000
    assert not {r.example_id for r in train} & {r.example_id for r in held_out}
    assert sum(r["count"] for r in held_out) >= 150


def test_rules_of_ones_own_reach_every_rule(spark):
    own = RuleSet(
        party_labels=("SELLER",), boilerplate=(r"\bknown as\b",), clauses=(r"\bmust\b",), clause_lead_chars=3, max_name_words=4,
        min_name_chars=6, date_words=("someday",), party_words=("nobody",), filing_markers=("docket",),
    )
    entries = ["SELLER: Acme", "LANDLORD: Acme", "Acme Ltd known as A", "Bo known as B", "it must pay", "Acme one must pay for two", "Acme must pay", "Acme (hereinafter X)"]
    label = json.dumps({"parties": entries, "effective_date": "Someday soon"})
    df = spark.createDataFrame([(1, [("user", "See DOCKET 5"), ("assistant", label)])], schemas.EXAMPLE)
    row = cleaning.clean_examples(df, own).first()
    kept = json.loads(row.messages[1].content)["parties"]
    assert kept == ["Acme", "LANDLORD: Acme", "Acme Ltd", "it must pay", "Acme must pay", "Acme (hereinafter X)"]
    assert row.effective_date_flagged and not cleaning.clean_examples(df).first().effective_date_flagged
    counts = lambda rules: {r.doc_type: r.n for r in evaluation.doc_type_counts(df, rules).collect()}
    assert counts(own) == {"templated_synthetic": 0, "real_world_sec_style": 1}
    assert counts(RuleSet(filing_markers=("none",))) == {"templated_synthetic": 1, "real_world_sec_style": 0}
    flagged = [evaluation.prepare_truth(df, r).first().flagged for r in (own, RuleSet(date_words=("never",), party_words=("nobody",)))]
    assert flagged == [True, False]


def test_written_metrics_are_one_json_text(spark, tmp_path):
    rows = [(scope, model, 3, 50.0) for scope in ("overall", "templated_synthetic") for model in ("b", "a")]
    metrics = spark.createDataFrame(rows, "scope string, model string, n long, v double")
    metrics = metrics.select("scope", "model", "n", *[F.col("v").alias(m) for m in evaluation.METRICS])
    path = str(tmp_path / "metrics")
    for _ in range(2):  # a second run replaces the first
        tables.write_metrics(reporting.metrics_json(metrics), path)
    written = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(written) == 1 and set(written[0]) == {"overall", "by_document_type"}
    assert written[0]["overall"]["a"]["n"] == 3 and written[0]["overall"]["b"]["field_f1"]["parties"] == 50.0
    assert set(written[0]["by_document_type"]["templated_synthetic"]) == {"a", "b"}
