"""Shapes of physical plans that the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from contractspark.operators import chunking, evaluation, split
from contractspark.plans import fixtures
from contractspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """The plan of the rows themselves, without scalar subqueries."""
    return plan(df).split("Subquery")[0]


@pytest.mark.parametrize("name", ["metrics_by_type", "qa_to_contracts", "merge_chunks", "cleaning_report", "chunk_pages_blocked", "doc_text"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, SF)))


def test_evaluation_parses_each_text_once(spark):
    text = plan(QUERIES["metrics_by_type"](spark, SF))
    # the prediction, its repaired form, and the truth
    assert text.count("from_json(") == 3
    assert text.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["metrics_by_type", "markdown_table"])
def test_scoring_stages_its_texts_and_shuffles_no_lists(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "transform(array(from_json" not in text and "transform(array(trim" not in text
    truth = evaluation.prepare_truth(fixtures.examples(spark, SF))
    assert not [f.name for f in truth.schema if f.dataType.typeName() == "array"]


def test_scoring_normalises_and_shuffles_no_text_twice(spark):
    text = plan(QUERIES["markdown_table"](spark, SF))
    assert not re.search(r"THEN _normal_(liability_cap|termination_conditions)#\d+ END AS", text)  # the keys hold them
    assert "_normal_parties" not in plan(evaluation.prepare_truth(fixtures.examples(spark, SF)))


def test_cleaning_parses_each_label_once_and_stays_in_the_jvm(spark):
    text = plan(QUERIES["clean_parties"](spark, SF))
    assert text.count("from_json(") == 1 and "Python" not in text


def test_split_moves_no_rows(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("example_id"), F.lit("text").alias("t")).write.parquet(str(tmp_path / "x"))
    train, held_out = split.split_train_eval(spark.read.parquet(str(tmp_path / "x")))
    for part in (train, held_out):
        rows = main_plan(part)
        assert "Exchange" not in rows and "Join" not in rows


def test_facts_are_combined_before_the_shuffle(spark):
    text = plan(QUERIES["merge_chunks"](spark, SF))
    assert re.search(r"Exchange hashpartitioning\(doc_id#\d+L, field#\d+, value#\d+", text)
    assert "partial_min(seen" in text


def test_short_documents_need_one_shuffle_and_no_python(spark, tmp_path):
    spark.createDataFrame([(d, p, "a b") for d in range(9) for p in range(3)], "doc_id long, page_no long, text string").write.parquet(str(tmp_path / "p"))
    text = plan(chunking.chunk_pages(spark.read.parquet(str(tmp_path / "p")), 5))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "Join" not in text


def test_blocks_are_walked_in_order_without_a_frame_each(spark):
    rows = [(d, p, "w " * ((d * 7 + p * 5) % 9)) for d in range(6) for p in range(d * 3 + 1)] + [(5, None, "x y"), (5, 3, "z")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    whole = {tuple(r) for r in chunking.chunk_pages(pages, 10).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # groups go on from batch to batch
    try:
        blocked = chunking.chunk_pages(pages, 10, block_pages=4, fan_in=2)
        assert {tuple(r) for r in blocked.collect()} == whole and len(whole) > 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan(blocked)


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["doc_type_counts"](spark, SF))
    assert "o_orderpriority" not in text and "c_mktsegment" not in text
