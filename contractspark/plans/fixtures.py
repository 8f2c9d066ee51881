"""Inputs derived from the driver tables, as one SQL text per view for Spark and the SQL oracle.

The raw tables hold no contracts, so examples, predictions, question-answer rows, candidates, chunk
outputs, pages and upload bodies are derived from whole tables by these views (see FIXTURES.md). The
only dialect difference is how a row is repeated for a short list of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import chat

def _each(dialect: str, name: str, values: list[int]) -> str:
    """A lateral repetition of the row before it, once per value."""
    items = ", ".join(str(v) for v in values)
    if dialect == "spark":
        return f", LATERAL explode(array({items})) AS v({name})"
    return f", unnest([{items}]) AS v({name})"


def _examples(_: str) -> str:
    return """
WITH b AS (
  SELECT o_orderkey AS example_id, c_name AS name, CAST(floor(o_totalprice) AS BIGINT) AS cap,
    CASE o_orderkey % 10
      WHEN 0 THEN c_name
      WHEN 1 THEN 'TENANT: ' || c_name
      WHEN 2 THEN c_name || ' (hereinafter Buyer)'
      WHEN 3 THEN c_name || ', a Delaware corporation'
      WHEN 4 THEN 'Premier shall have the right to terminate this Agreement'
      WHEN 5 THEN c_name || ' residing at 1 Main Street'
      WHEN 6 THEN c_name || ' with its affiliates in each country where the group operates today agrees to supply goods'
      WHEN 7 THEN 'LANDLORD:'
      WHEN 8 THEN ', a company'
      ELSE c_name || ' Holdings Trading Company of the Northern Southern Eastern Western Region with Several Branches'
    END AS p1,
    'Acme ' || CAST(o_custkey % 50 AS STRING) || ' LLC' AS p2,
    CASE o_orderkey % 6
      WHEN 0 THEN 'March ' || CAST(day(o_orderdate) AS STRING) || ', ' || CAST(year(o_orderdate) AS STRING)
      WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
      WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
      WHEN 3 THEN CAST(day(o_orderdate) AS STRING) || ' Sep ' || CAST(year(o_orderdate) AS STRING)
      WHEN 4 THEN 'upon notice of termination by either side'
      ELSE 'Not Specified'
    END AS eff
  FROM orders JOIN customer ON o_custkey = c_custkey
), l AS (
  SELECT *, 'USD ' || CAST(cap AS STRING) AS cap_text,
    CASE WHEN example_id % 4 = 0 THEN 'Not Specified' ELSE 'Either side may end this contract with ' || CAST(example_id % 90 + 1 AS STRING) || ' days notice' END AS term
  FROM b
)
SELECT example_id, 'Extract JSON from legal text.' AS system_text,
  CASE example_id % 3 WHEN 0 THEN 'EXHIBIT 10.1 ' WHEN 1 THEN 'Filed as 10-K annex. ' ELSE '' END
    || 'This agreement is made by ' || p1 || ' and ' || p2 || ', effective ' || eff || '. The total liability is limited to ' || cap_text || '. ' || term || '.' AS user_text,
  CASE
    WHEN example_id % 23 = 0 THEN '{}'
    WHEN example_id % 29 = 1 THEN '{"parties": ["' || p1
    WHEN example_id % 7 = 3 THEN '{"parties": "' || p1 || ', ' || p2 || '", "effective_date": "' || eff || '", "liability_cap": "' || cap_text || '", "termination_conditions": "' || term || '"}'
    ELSE '{"parties": ["' || p1 || '", "' || p2 || '"], "effective_date": "' || eff || '", "liability_cap": "' || cap_text || '", "termination_conditions": "' || term || '"}'
  END AS assistant_text,
  p1 AS label_p1, p2 AS label_p2, eff AS label_date, cap_text AS label_cap, term AS label_term
FROM l"""


def _predictions(dialect: str) -> str:
    return f"""
WITH e AS (
  SELECT example_id, CASE WHEN shift = 0 THEN 'base' ELSE 'tuned' END AS model,
    CASE WHEN shift = 3 AND example_id % 3 = 0 THEN 0 ELSE example_id % 8 END AS kind,
    '"effective_date": "' || label_date || '", "liability_cap": "' || label_cap || '", "termination_conditions": "' || label_term || '"}}' AS tail,
    label_p1, label_p2, label_cap
  FROM fx_examples{_each(dialect, "shift", [0, 3])}
)
SELECT example_id, model, kind,
  CASE kind
    WHEN 0 THEN '{{"parties": ["' || label_p1 || '", "' || label_p2 || '"], ' || tail
    WHEN 1 THEN '```json' || chr(10) || '{{"parties": ["' || label_p2 || '"], ' || tail || chr(10) || '```'
    WHEN 2 THEN '{{"parties": ["Zyxwv Quorum Partners", "' || label_p2 || '"], ' || tail
    WHEN 3 THEN '{{"parties": "' || label_p1 || ' and ' || label_p2 || '", "effective_date": "Not Specified", "liability_cap": "' || label_cap || '", "termination_conditions": "unknown gibberish wording qqq"}}'
    WHEN 4 THEN '{{"parties": ["' || label_p2 || '"], ' || tail || ' I hope this helps.'
    WHEN 5 THEN '{{"parties": ["' || label_p2 || '"], "effective_date": "2024'
    WHEN 6 THEN '{{"liability_cap": "' || label_cap || '", "termination_conditions": "ends upon breach of a term' || repeat(' the buyer may end the deal ', 30)
    ELSE 'I could not find any data.'
  END AS output_text
FROM e"""


def _qa(dialect: str) -> str:
    return f"""
WITH a AS (
  SELECT coalesce(o_orderkey, 1000000000 + doc_id) AS o_orderkey, coalesce(o_custkey, doc_id) AS o_custkey,
    coalesce(o_orderdate, CAST('1995-06-01' AS DATE)) AS o_orderdate, text
  FROM documents LEFT JOIN orders ON doc_id = CAST(floor(o_custkey * 2 / 3) AS BIGINT)
), q AS (
  SELECT o_orderkey, o_custkey, o_orderdate, text, k,
    CASE k WHEN 0 THEN 'Highlight the parts related to "Parties".' WHEN 1 THEN 'What is the Effective Date?'
      WHEN 2 THEN 'Is there a Liability Cap?' WHEN 3 THEN 'Can one side TERMINATE without cause?'
      ELSE 'What is the Governing Law?' END AS question
  FROM a{_each(dialect, "k", [0, 1, 2, 3, 4])}
)
SELECT o_orderkey * 5 + k AS row_id, 'Agreement ' || CAST(o_custkey % 900 AS STRING) || '. ' || text AS context, question,
  CASE
    WHEN (o_orderkey + k) % 4 = 0 OR o_custkey % 9 = 0 OR (o_custkey % 9 = 1 AND k < 2) THEN NULL
    WHEN k = 0 THEN '  Party ' || CAST(o_orderkey % 3 AS STRING) || ' '
    WHEN k = 1 THEN CAST(year(o_orderdate) AS STRING) || '-01-15'
    WHEN k = 2 THEN 'USD ' || CAST(o_orderkey AS STRING)
    WHEN k = 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Not Specified' ELSE 'with ' || CAST(o_orderkey % 60 AS STRING) || ' days notice' END
    ELSE 'State law'
  END AS answer1,
  CASE WHEN (o_orderkey + k) % 4 = 1 AND o_custkey % 9 > 1 THEN 'second answer' ELSE NULL END AS answer2
FROM q"""


def _candidates(dialect: str) -> str:
    return f"""
WITH c AS (
  SELECT o_orderkey AS example_id, attempt, c_name,
    CASE WHEN o_orderkey % 11 = 10 THEN 1 ELSE (o_orderkey + attempt) % 6 END AS kind
  FROM (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) AS oc{_each(dialect, "attempt", [0, 1, 2, 3, 4])}
)
SELECT example_id, attempt, kind,
  CASE kind
    WHEN 0 THEN '{{"messy_text": "Agreement of ' || c_name || ' dated 2024-02-03 capped at USD 500", "parties": ["' || c_name || '"], "effective_date": "2024-02-03", "liability_cap": "USD 500", "termination_conditions": "not in text at all", "extra": 1}}'
    WHEN 1 THEN '{{"messy_text": "Agreement of ' || c_name || '", "parties": ["Zyxwv Quorum"], "effective_date": "Not Specified", "liability_cap": "N/A", "termination_conditions": "none"}}'
    WHEN 2 THEN '{{"messy_text": "Agreement of ' || c_name || '", "parties": ["' || c_name || '"], "effective_date": "May 7, 1999", "liability_cap": "none", "termination_conditions": ""}}'
    WHEN 3 THEN '{{"messy_text": "cut off here'
    WHEN 4 THEN '{{"parties": [], "effective_date": "", "liability_cap": "", "termination_conditions": ""}}'
    ELSE '{{"messy_text": "AGREEMENT OF ' || c_name || ' signed in march for USD 900 total", "parties": ["agreement of ' || c_name || ' inc"], "effective_date": "signed in march then", "liability_cap": "usd 900", "termination_conditions": "Not Specified"}}'
  END AS raw_content
FROM c"""


def _chunk_outputs(_: str) -> str:
    return """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS chunk_no,
  (l_orderkey + l_linenumber) % 6 AS kind,
  CASE (l_orderkey + l_linenumber) % 6
    WHEN 0 THEN 'no json here'
    WHEN 1 THEN '```json' || chr(10) || '{"parties": ["Vendor ' || CAST(l_suppkey % 3 AS STRING) || '", "Not Specified"], "effective_date": "Not Specified", "liability_cap": "USD ' || CAST(l_linenumber AS STRING) || '", "termination_conditions": "Not Specified"}' || chr(10) || '```'
    WHEN 2 THEN 'Answer: {"parties": ["Vendor ' || CAST(l_suppkey % 3 AS STRING) || '", "Buyer"], "effective_date": "' || CAST(year(l_shipdate) AS STRING) || '-0' || CAST(l_linenumber AS STRING) || '-01", "liability_cap": "Not Specified", "termination_conditions": "clause ' || CAST(l_linenumber AS STRING) || '"} trailing words'
    WHEN 3 THEN '{"parties": ["Not Specified"], "effective_date": "Not Specified", "liability_cap": "Not Specified", "termination_conditions": "Not Specified"}'
    WHEN 4 THEN '{"parties": ["Buyer"]}'
    ELSE '{"parties": ["Agent ' || CAST(l_partkey % 4 AS STRING) || '"], "effective_date": null, "liability_cap": ""}'
  END AS output_text
FROM lineitem"""


def _pages(_: str) -> str:
    return "\nSELECT conv_id AS doc_id, turn AS page_no, text FROM conversations"


def _payload(_: str) -> str:
    return """
SELECT page_id,
  CASE page_id % 5
    WHEN 0 THEN '--b1 form-data ' || '%PDF-1.7 ' || html || ' %%EOF' || ' --b1--'
    WHEN 1 THEN 'x %PDF-1.4 ' || html || ' no end mark'
    WHEN 2 THEN 'plain body ' || html
    WHEN 3 THEN '%PDF-1.5 a %%EOF ' || html || ' %%EOF tail ' || url
    ELSE '%%EOF only before %PDF-1.6 ' || html
  END AS body_text
FROM pages"""


VIEWS = {
    "fx_examples": _examples,
    "fx_predictions": _predictions,
    "fx_qa": _qa,
    "fx_candidates": _candidates,
    "fx_chunk_outputs": _chunk_outputs,
    "fx_pages": _pages,
    "fx_payload": _payload,
}
READS = {
    "fx_examples": ("orders", "customer"),
    "fx_predictions": (),
    "fx_qa": ("orders", "documents"),
    "fx_candidates": ("orders", "customer"),
    "fx_chunk_outputs": ("lineitem",),
    "fx_pages": ("conversations",),
    "fx_payload": ("pages",),
}
NEEDS = {"fx_predictions": ("fx_examples",)}


def sql_prefix(*views: str) -> str:
    """``WITH RECURSIVE`` clause that defines the named views for the SQL oracle."""
    order: list[str] = []
    for view in views:
        for name in (*NEEDS.get(view, ()), view):
            if name not in order:
                order.append(name)
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v]('duckdb')}\n)" for v in order)


def _scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table as it lies."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or fixture view, lazily, over the files in ``sf_dir``."""
    if name not in VIEWS:
        return _scan(spark, sf_dir, name)
    for table in READS[name]:
        _scan(spark, sf_dir, table).createOrReplaceTempView(table)
    for view in NEEDS.get(name, ()):
        load(spark, sf_dir, view).createOrReplaceTempView(view)
    return spark.sql(VIEWS[name]("spark"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_examples as ``example_id, messages``."""
    fx = load(spark, sf_dir, "fx_examples")
    return fx.select("example_id", chat(F.col("user_text"), F.col("assistant_text"), F.col("system_text")).alias("messages"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_predictions").select("model", "example_id", "output_text")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_qa with its answers as one array."""
    texts = F.array_compact(F.array("answer1", "answer2"))
    fx = load(spark, sf_dir, "fx_qa")
    return fx.select("row_id", "context", "question", F.struct(texts.alias("text")).alias("answers"))
