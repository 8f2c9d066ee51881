"""Every registered query against its SQL on the smallest tables, and a check that it is not vacuous."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from contractspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "lineitem", "documents", "conversations", "pages")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def canonical(rows: pd.DataFrame) -> pd.DataFrame:
    def text(value):
        if value is None or (not isinstance(value, str) and pd.isna(value)):
            return None
        return repr(float(value)) if isinstance(value, float) else str(value)

    rows = rows[sorted(rows.columns)].astype(object).map(text)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    relation = duck.sql(entry_module.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    got, want = canonical(df.toPandas()), canonical(relation.df())
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got, want)


# columns that must show both (or all) outcomes, so that no rule passes by never firing
OUTCOMES = {
    "validate_candidates": ("reason", {None, "bad_json", "party", "effective_date", "no_messy_text"}),
    "clean_entries": ("reason", {"", "truncated", "dropped"}),
    "flag_truth": ("flags", {"", "effective_date", "parties", "effective_date|parties"}),
    "doc_type": ("doc_type", {"templated_synthetic", "real_world_sec_style"}),
    "flag_dates": ("flagged", {True, False}),
    "grounding_raw": ("grounded", {True, False}),
    "hallucination": ("parties", {True, False}),
    "first_json_object": ("found", {True, False}),
    "parse_outputs": ("was_truncated", {True, False}),
    "carve_payload": ("error", {None, "No valid PDF header found."}),
    "route_questions": ("field", {None, "parties", "effective_date", "liability_cap", "termination_conditions"}),
}


@pytest.mark.parametrize("name", list(OUTCOMES))
def test_all_outcomes_occur(spark, name):
    column, wanted = OUTCOMES[name]
    seen = {r[0] for r in entry_module.queries()[name](spark, SF).select(column).distinct().collect()}
    assert wanted <= seen


def test_entry(spark):
    assert entry_module.entry(spark).count() == 6
