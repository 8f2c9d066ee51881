"""SQL for the registered queries, written for an independent engine over the same tables.

The helpers below build SQL text; they share the fixed values with the library but none of its logic.
"""

from __future__ import annotations

from ..functions.text import NOT_WORD_OR_SPACE, SPACE_RUN, WHITESPACE
from ..rules import (
    BOILERPLATE_PATTERNS, CLAUSE_PATTERNS, CONTRACT_TYPES, DOC_TYPES, FIELDS, FILING_MARKERS, HEADER_END, HEADER_START,
    PARTY_LABELS, PROMPT_HEAD, PROMPT_TAIL, SCALAR_FIELDS, SERVING_SYSTEM, SUSPICIOUS_DATE_WORDS,
    SUSPICIOUS_PARTY_WORDS, TURN_END, candidate_json_schema,
)
from .fixtures import sql_prefix

PAGE_BUDGET = 200
P, D, C, T = FIELDS


# ---- SQL text helpers ------------------------------------------------------------------------------
def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_RUN}', ' ', 'g'))"


def norm(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '{NOT_WORD_OR_SPACE}', '', 'g')"
    return f"coalesce({collapse(bare)}, '')"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''))"


def any_in(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def share(value: str, source: str) -> str:
    w = words(value)
    return f"(len(list_filter({w}, lambda w: contains({source}, w))) / nullif(len({w}), 0))"


def grounded(value: str, lower_source: str) -> str:
    v = strip(f"lower({value})")
    return (
        f"(CASE WHEN coalesce({v}, 'none') IN ('not specified', 'none', 'n/a', '') THEN true "
        f"WHEN contains({lower_source}, {v}) THEN true ELSE coalesce({share(v, lower_source)} >= 0.75, true) END)"
    )


def wrong(value: str, normal_source: str) -> str:
    v = norm(value)
    return (
        f"(CASE WHEN {strip(f'lower({value})')} IN ('not specified', 'n/a', '') THEN false "
        f"WHEN contains({normal_source}, {v}) THEN false ELSE coalesce({share(v, normal_source)} < 0.75, false) END)"
    )


def iso_date(x: str) -> str:
    formats = "['%B %d, %Y','%b %d, %Y','%B %d %Y','%b %d %Y','%Y-%m-%d','%m/%d/%Y','%d/%m/%Y','%d %B %Y','%d %b %Y']"
    return f"coalesce(strftime(try_strptime({strip(x)}, {formats}), '%Y-%m-%d'), {norm(x)})"


def party_set(x: str) -> str:
    cut = f"regexp_split_to_array({x}, '(?i),|;|\\band\\b')"
    return f"list_distinct(list_filter(list_transform({cut}, lambda p: {norm('p')}), lambda p: p <> ''))"


def f1(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    p, r = f"({common} / nullif(len({a}), 0))", f"({common} / nullif(len({b}), 0))"
    return (
        f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 OR {common} = 0 "
        f"THEN 0.0::DOUBLE ELSE 2 * ({p} * {r}) / ({p} + {r}) END)"
    )


def scored(field: str, pred: str, truth: str) -> str:
    if field == P:
        return f1(party_set(pred), party_set(truth))
    if field == D:
        return f"(CASE WHEN {iso_date(pred)} = {iso_date(truth)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f1(token_set(pred), token_set(truth))


def quoted_list(items: str) -> str:
    return f"'[' || array_to_string(list_transform({items}, lambda p: '''' || p || ''''), ', ') || ']'"


def py_text(j: str, field: str) -> str:
    """Python str() of a field of a JSON value (text, list of plain texts, null, missing)."""
    listed = quoted_list(f"CAST(json_extract({j}, '$.{field}') AS VARCHAR[])")
    return (
        f"(CASE json_type({j}, '$.{field}') WHEN 'ARRAY' THEN {listed} WHEN 'NULL' THEN 'None' "
        f"ELSE coalesce(json_extract_string({j}, '$.{field}'), '') END)"
    )


def valid_json(x: str) -> str:
    return f"(CASE WHEN {strip(x)} LIKE '{{%' AND json_valid({x}) THEN {x} END)"


ONE_PATTERN = r"(?is)^(.*?)(?:{})"
CLAUSE = "(?i)" + "|".join(CLAUSE_PATTERNS)
WRAPPER = "(?i)" + "|".join(BOILERPLATE_PATTERNS)
CLAUSE_LEAD = ONE_PATTERN.format("|".join(CLAUSE_PATTERNS))
WRAPPER_LEAD = ONE_PATTERN.format("|".join(BOILERPLATE_PATTERNS))
LABEL = r"(?i)^\s*(" + "|".join(PARTY_LABELS) + r")\s*:\s*"

EX = sql_prefix("fx_examples")
LAB = EX + f""",
lab AS (SELECT *, {valid_json('assistant_text')} AS j FROM fx_examples),
truth AS (SELECT example_id, user_text, {', '.join(f"{py_text('j', f)} AS {f}" for f in FIELDS)} FROM lab)"""
FILING = f"CASE WHEN {any_in('lower(user_text)', FILING_MARKERS)} THEN 'real_world_sec_style' ELSE 'templated_synthetic' END"

# party entries, one row each, with the cleaning verdict
ITEMS = LAB + f""",
survivors AS (SELECT example_id, j FROM lab WHERE j IS NOT NULL AND len(json_keys(j)) > 0),
entry_lists AS (SELECT example_id, CASE json_type(j, '$.parties')
    WHEN 'ARRAY' THEN CAST(json_extract(j, '$.parties') AS VARCHAR[])
    WHEN 'VARCHAR' THEN list_filter(list_transform(regexp_split_to_array(json_extract_string(j, '$.parties'), '[,;]'), lambda p: {strip('p')}), lambda p: p <> '')
  END AS entries FROM survivors),
entries AS (SELECT example_id, unnest(range(len(entries))) AS pos, unnest(entries) AS original FROM entry_lists),
named AS (SELECT *, {strip(f"regexp_replace({strip('original')}, '{LABEL}', '')")} AS name FROM entries),
located AS (SELECT *, regexp_matches(name, '{CLAUSE}') AS has_clause, regexp_matches(name, '{WRAPPER}') AS has_wrapper,
    length(regexp_extract(name, '{CLAUSE_LEAD}', 1)) AS clause_at,
    {strip(f"rtrim({strip(f'''regexp_extract(name, '{WRAPPER_LEAD}', 1)''')}, ',')")} AS lead FROM named),
items AS (SELECT example_id, pos, original,
    CASE WHEN {strip('original')} = '' OR (has_clause AND clause_at < 15) THEN 'dropped'
      WHEN has_wrapper AND length(lead) >= 2 THEN 'truncated' WHEN has_wrapper THEN 'dropped'
      WHEN has_clause AND len({words('name')}) > 12 THEN 'dropped' ELSE '' END AS reason, lead, name FROM located),
cleaned_items AS (SELECT example_id, pos, original, reason,
    CASE reason WHEN 'dropped' THEN '' WHEN 'truncated' THEN lead ELSE name END AS cleaned FROM items),
per_example AS (SELECT s.example_id, s.j,
    coalesce(list(cleaned ORDER BY pos) FILTER (WHERE reason <> 'dropped'), []) AS kept,
    coalesce(list(original ORDER BY pos) FILTER (WHERE reason = 'dropped'), []) AS dropped,
    coalesce(list(original || ' => ' || cleaned ORDER BY pos) FILTER (WHERE reason = 'truncated'), []) AS pairs
  FROM survivors s LEFT JOIN cleaned_items i ON i.example_id = s.example_id GROUP BY s.example_id, s.j),
report AS (SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS example_index, len(dropped) + len(pairs) > 0 AS modified,
    {any_in("lower(coalesce(json_extract_string(j, '$.effective_date'), ''))", SUSPICIOUS_DATE_WORDS)} AS flagged FROM per_example)"""

# predictions parsed; the looping outputs are the fixture's kind 6 and keep only their first pair
LOOP_HEAD = "'{\"liability_cap\": \"' || label_cap || '\", \"termination_conditions\": \"ends upon breach of a term'"
LF = "chr(10)"
BODY = (
    f"(CASE WHEN trim({strip('output_text')}, '`') LIKE 'json%' "
    f"THEN ltrim(substr(trim({strip('output_text')}, '`'), 5), {LF}) ELSE trim({strip('output_text')}, '`') END)"
)
PRED = LAB.replace(EX, sql_prefix("fx_predictions")) + f""",
direct AS (SELECT p.model, p.example_id, p.kind, {valid_json(BODY)} AS k, e.label_cap
  FROM fx_predictions p JOIN fx_examples e ON e.example_id = p.example_id),
parsed AS (SELECT model, example_id, k IS NULL AND kind <> 6 AS parse_failed, kind = 6 AS was_truncated,
    {', '.join(f"CASE WHEN kind = 6 THEN {'label_cap' if f == C else lit('')} ELSE {py_text('k', f)} END AS {f}" for f in FIELDS)}
  FROM direct)"""
PAIRED = PRED + f""",
paired AS (SELECT p.model, p.example_id, p.parse_failed, p.was_truncated, t.user_text,
    {', '.join(f"p.{f} AS p_{f}, t.{f} AS t_{f}" for f in FIELDS)} FROM parsed p JOIN truth t ON t.example_id = p.example_id)"""
SCORED = PAIRED + f""",
sourced AS (SELECT *, {norm('user_text')} AS source FROM paired),
scored AS (SELECT model, example_id, {FILING} AS doc_type, parse_failed, was_truncated,
    {any_in(norm(f't_{D}'), SUSPICIOUS_DATE_WORDS)} OR {any_in(f'lower(t_{P})', SUSPICIOUS_PARTY_WORDS)} AS flagged,
    {', '.join(f"{scored(f, f'p_{f}', f't_{f}')} AS s_{f}" for f in FIELDS)},
    {', '.join(f"{wrong(f'p_{f}', 'source')} AS h_{f}" for f in FIELDS)},
    {', '.join(f"{strip(f'lower(t_{f})')} NOT IN ('not specified', 'n/a', '') AS f_{f}" for f in FIELDS)} FROM sourced)"""


def _metrics(extra_filter: str = "true") -> str:
    def pct(part: str, whole: str) -> str:
        return f"coalesce(round(({part}) / nullif({whole}, 0) * 100, 2), 0.0)"

    n = "count(example_id)"
    total = " + ".join(f"s_{f}" for f in FIELDS)
    exact = " AND ".join(f"s_{f} = 1.0" for f in FIELDS)
    bad = " + ".join(f"CAST(h_{f} AS INT)" for f in FIELDS)
    filled = " + ".join(f"CAST(f_{f} AS INT)" for f in FIELDS)
    both = " + ".join(f"CAST(h_{f} AND f_{f} AS INT)" for f in FIELDS)
    return f""",
scopes AS (SELECT unnest(['overall', 'templated_synthetic', 'real_world_sec_style']) AS scope),
slots AS (SELECT DISTINCT model, scope FROM fx_predictions, scopes),
metrics AS (SELECT s.model, s.scope, {n} AS n,
    {pct(f'sum(({total}) / 4)', n)} AS overall_f1,
    {pct(f'count_if({exact})', n)} AS exact_match_rate,
    {pct(f'sum({bad})', f'({n} * 4)')} AS hallucination_rate,
    {pct(f'sum({both})', f'sum({filled})')} AS hallucination_rate_on_populated_fields,
    {pct('count_if(parse_failed)', n)} AS json_parse_failure_rate,
    {pct('count_if(was_truncated)', n)} AS salvaged_via_truncation_rate,
    {pct('count_if(flagged)', n)} AS flagged_ground_truth_rate,
    {', '.join(f"{pct(f'sum(s_{f})', n)} AS f1_{f}" for f in FIELDS)}
  FROM slots s LEFT JOIN (SELECT * FROM scored WHERE {extra_filter}) x
    ON x.model = s.model AND (s.scope = 'overall' OR s.scope = x.doc_type) GROUP BY s.model, s.scope)"""


METRIC_NAMES = (
    "overall_f1", "exact_match_rate", "hallucination_rate", "hallucination_rate_on_populated_fields",
    "json_parse_failure_rate", "salvaged_via_truncation_rate", "flagged_ground_truth_rate",
    *(f"f1_{f}" for f in FIELDS),
)
METRICS = SCORED + _metrics()
SPLIT = EX + """,
ranked AS (SELECT example_id, row_number() OVER (ORDER BY md5('42:' || CAST(example_id AS VARCHAR))) AS r, count(*) OVER () AS n FROM fx_examples),
eval_ids AS (SELECT example_id FROM ranked WHERE r <= greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)))"""
VARIED = EX + """,
varied AS (SELECT *, CASE WHEN example_id % 5 = 0 THEN [] ELSE [assistant_text] END AS tail FROM fx_examples),
msgs AS (SELECT example_id, user_text, CASE WHEN example_id % 5 = 1 THEN '{}' WHEN example_id % 5 = 0 THEN NULL ELSE assistant_text END AS first_answer,
    CASE WHEN example_id % 5 = 1 THEN 0 WHEN example_id % 5 = 0 THEN -1 ELSE 2 END AS found_at FROM varied)"""
QA = sql_prefix("fx_qa") + f""",
routed AS (SELECT row_id, CASE WHEN length(context) > 3500 THEN substr(context, 1, 3500) || '...' ELSE context END AS context,
    CASE WHEN contains(lower(question), 'parties') THEN 'parties' WHEN contains(lower(question), 'effective date') THEN 'effective_date'
      WHEN contains(lower(question), 'liability cap') THEN 'liability_cap' WHEN contains(lower(question), 'terminate') THEN 'termination_conditions' END AS field,
    coalesce({strip('answer1')}, {strip('answer2')}, 'Not Specified') AS answer FROM fx_qa)"""


def _last(field: str) -> str:
    cond = f"field = '{field}' AND answer <> 'Not Specified'"
    return f"coalesce(arg_max(answer, row_id) FILTER (WHERE {cond}), 'Not Specified') AS {field}"


CONTRACTS = QA + f""",
seen AS (SELECT context, answer, min(row_id) AS r FROM routed WHERE field = 'parties' AND answer <> 'Not Specified' GROUP BY ALL),
named AS (SELECT context, string_agg(answer, '|' ORDER BY r) AS names FROM seen GROUP BY context),
scalars AS (SELECT context, min(row_id) AS row_id, {', '.join(_last(f) for f in SCALAR_FIELDS)} FROM routed GROUP BY context),
contracts AS (SELECT row_id, s.context, coalesce(names, 'Not Specified') AS parties, {', '.join(SCALAR_FIELDS)}
  FROM scalars s LEFT JOIN named n ON n.context = s.context WHERE names IS NOT NULL OR effective_date <> 'Not Specified')"""

CAND = sql_prefix("fx_candidates") + f""",
cj AS (SELECT *, {valid_json('raw_content')} AS j FROM fx_candidates),
cs AS (SELECT *, lower(coalesce(json_extract_string(j, '$.messy_text'), '')) AS src,
    coalesce(CAST(json_extract(j, '$.parties') AS VARCHAR[]), []) AS ps FROM cj),
checked AS (SELECT *, CASE WHEN j IS NULL THEN 'bad_json'
    WHEN len(list_filter(ps, lambda p: NOT {grounded('p', 'src')})) > 0 THEN 'party'
    WHEN NOT {grounded("json_extract_string(j, '$.effective_date')", 'src')} THEN 'effective_date'
    WHEN NOT {grounded("json_extract_string(j, '$.liability_cap')", 'src')} THEN 'liability_cap'
    WHEN json_type(j, '$.messy_text') IS DISTINCT FROM 'VARCHAR' THEN 'no_messy_text' END AS reason FROM cs),
accepted AS (SELECT * FROM checked WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY attempt) = 1)"""

TOKEN = rf"[\p{{L}}\p{{N}}_]+|{NOT_WORD_OR_SPACE}"
CHUNKS = sql_prefix("fx_pages") + f""",
sized AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i, text || chr(10) || chr(10) AS body,
    len(regexp_extract_all(text, '{TOKEN}')) AS t FROM fx_pages),
walk AS (SELECT doc_id, i, 1 AS chunk_no, t AS open FROM sized WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN open + s.t > {PAGE_BUDGET} THEN chunk_no + 1 ELSE chunk_no END,
    CASE WHEN open + s.t > {PAGE_BUDGET} THEN s.t ELSE open + s.t END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
joined AS (SELECT w.doc_id, w.chunk_no, {strip("string_agg(body, '' ORDER BY w.i)")} AS chunk_text
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY w.doc_id, w.chunk_no),
chunks AS (SELECT * FROM joined QUALIFY chunk_text <> '' OR chunk_no < max(chunk_no) OVER (PARTITION BY doc_id))"""

UNFENCED = "replace(replace(output_text, '```json', ''), '```', '')"
FROM_BRACE = f"substr({UNFENCED}, strpos({UNFENCED}, '{{'))"
TO_BRACE = f"regexp_replace({FROM_BRACE}, '[^}}]*$', '')"  # the fixture nests no objects
OBJECTS = sql_prefix("fx_chunk_outputs") + f""",
objs AS (SELECT *, CASE WHEN strpos({UNFENCED}, '{{') > 0 THEN {valid_json(TO_BRACE)} END AS j FROM fx_chunk_outputs)"""


def _first(field: str) -> str:
    value = f"json_extract_string(j, '$.{field}')"
    cond = f"json_type(j, '$.{field}') IS NOT NULL AND {value} IS DISTINCT FROM 'Not Specified'"
    rec = f"arg_min({{'v': {value}}}, chunk_no) FILTER (WHERE {cond})"
    return f"CASE WHEN count(*) FILTER (WHERE {cond}) = 0 THEN 'Not Specified' ELSE ({rec}).v END AS {field}"


MERGED = OBJECTS + f""",
ps AS (SELECT doc_id, chunk_no, unnest(range(len(l))) AS pos, unnest(l) AS party
  FROM (SELECT doc_id, chunk_no, CAST(json_extract(j, '$.parties') AS VARCHAR[]) AS l FROM objs) x),
firsts AS (SELECT doc_id, party, min(chunk_no * 1000 + pos) AS o FROM ps WHERE party <> 'Not Specified' GROUP BY ALL),
plists AS (SELECT doc_id, list(party ORDER BY o) AS parties FROM firsts GROUP BY doc_id),
mscalars AS (SELECT doc_id, {', '.join(_first(f) for f in SCALAR_FIELDS)} FROM objs GROUP BY doc_id),
merged AS (SELECT s.doc_id, coalesce(parties, []) AS parties, {', '.join(SCALAR_FIELDS)} FROM mscalars s LEFT JOIN plists p ON p.doc_id = s.doc_id)"""

HEAD = {r: lit(HEADER_START + r + HEADER_END) for r in ("system", "user", "assistant")}
PROMPT = (
    f"{HEAD['system']} || {lit(SERVING_SYSTEM + TURN_END)} || {HEAD['user']} || "
    f"'Document text:' || chr(10) || '\"\"\"' || chr(10) || {{}} || chr(10) || '\"\"\"{TURN_END}' || {HEAD['assistant']}"
)
TRAINING = " || ".join(f"{HEAD[r]} || {r}_text || '{TURN_END}'" for r in ("system", "user"))
TRAINING += f" || {HEAD['assistant']} || assistant_text || '{TURN_END}'"


def _audit(source: str, limit: int) -> str:
    return (
        f"SELECT count(*) AS n, (list(t ORDER BY t))[count(*) // 2 + 1] AS p50, "
        f"(list(t ORDER BY t))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, max(t) AS max_tokens, "
        f"count(*) FILTER (WHERE t > {limit}) AS over_limit FROM ({source}) AS x"
    )


def _tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN}')) AS BIGINT)"


# close_json: cut at the later of last comma and last brace, close the string, close the object
CUT = "rtrim(substr(output_text, 1, length(output_text) - 30), '" + WHITESPACE + "')"
CLOSED = sql_prefix("fx_predictions") + f""",
bodies AS (SELECT model, example_id, {CUT} AS b FROM fx_predictions),
marks AS (SELECT *, CASE WHEN strpos(reverse(b), ',') > 0 THEN length(b) - strpos(reverse(b), ',') + 1 ELSE 0 END AS comma,
    CASE WHEN strpos(reverse(b), '{{') > 0 THEN length(b) - strpos(reverse(b), '{{') + 1 ELSE 0 END AS brace FROM bodies),
heads AS (SELECT *, CASE WHEN comma > brace THEN left(b, comma - 1) ELSE left(b, brace) END AS h FROM marks),
quoted AS (SELECT *, CASE WHEN (length(h) - length(replace(h, '"', ''))) % 2 = 1 THEN h || '"' ELSE h END AS q FROM heads),
closings AS (SELECT model, example_id, CASE WHEN comma + brace > 0 THEN rtrim(rtrim(q, '{WHITESPACE}'), ',') || '}}' END AS closed FROM quoted)"""

DEMO = (
    f"(CASE WHEN strpos(trim({strip('output_text')}, '`'), 'json' || {LF}) > 0 THEN "
    f"left(trim({strip('output_text')}, '`'), strpos(trim({strip('output_text')}, '`'), 'json' || {LF}) - 1) || "
    f"substr(trim({strip('output_text')}, '`'), strpos(trim({strip('output_text')}, '`'), 'json' || {LF}) + 5) "
    f"ELSE trim({strip('output_text')}, '`') END)"
)
NO_JSON = lit("Model failed to output valid JSON.")
PICK = "CAST(CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 7 + 1 AS INT)"
METRIC_ROWS = ", ".join(f"({i}, {lit(m)})" for i, m in enumerate(METRIC_NAMES, 1))
METRIC_VALUE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in METRIC_NAMES) + " END"
TABLE = METRICS + f""",
positions AS (SELECT * FROM (VALUES {METRIC_ROWS}) AS v(position, metric)),
tab AS (SELECT position, metric, max({METRIC_VALUE}) FILTER (WHERE model = 'base') AS base,
    max({METRIC_VALUE}) FILTER (WHERE model = 'tuned') AS tuned
  FROM positions, (SELECT * FROM metrics WHERE scope = 'overall') m GROUP BY position, metric)"""
LABELS = (
    "**Overall F1 Score**", "**Exact Match Rate**", "**Hallucination Rate (all fields)**",
    "**Hallucination Rate (populated fields only)**", "**JSON Parse Failure Rate**",
    "**Salvaged via repetition-truncation**", "**Flagged (possibly mislabeled) ground truth**",
    *(f"`{f}`" for f in FIELDS),
)
LABEL_CASE = "CASE position " + " ".join(f"WHEN {i} THEN {lit(name)}" for i, name in enumerate(LABELS, 1)) + " END"
JSON_RECORD = (
    "'{' || " + " || ',' || ".join(f"'\"{m}\":' || CAST({m} AS VARCHAR)" for m in METRIC_NAMES[:7])
    + " || ',\"field_f1\":{' || " + " || ',' || ".join(f"'\"{f}\":' || CAST(f1_{f} AS VARCHAR)" for f in FIELDS)
    + " || '},\"n\":' || CAST(n AS VARCHAR) || '}'"
)
FIRST_ANSWER = f"coalesce({strip('answer1')}, {strip('answer2')}, 'Not Specified')"
SPLIT_TEXT = "label_p1 || '; AND ' || label_p2 || ', ' || label_p2"


def _fields(j: str) -> str:
    return ", ".join(f"{py_text(j, f)} AS {f}" for f in FIELDS)


# lines that _faulty_lines spoils, and a line as it is written
BAD = "CASE WHEN example_id % 50 IN (1, 2) THEN 'not_json' WHEN example_id % 50 = 3 THEN 'not_object' WHEN example_id % 50 = 4 THEN 'messages' WHEN example_id % 50 = 5 THEN 'example_id' END"
LINE = """('{"example_id":' || example_id || ',"messages":' || CAST(to_json([{role: 'system', content: system_text}, {role: 'user', content: user_text}, {role: 'assistant', content: assistant_text}]) AS VARCHAR) || ',"note":"n' || example_id || '"}')"""

# the printed report: (section, line in it, text)
REPORT_SCOPES = (
    ("overall", "Overall Model Evaluation Results (blended)"), ("templated_synthetic", "Results on templated/synthetic documents only"),
    ("real_world_sec_style", "Results on real-world/SEC-filing-style documents only"),
)
REPORT = METRICS + f""",
positions AS (SELECT * FROM (VALUES {METRIC_ROWS}) AS v(position, metric)),
titles AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lit(s)}, {lit(t)})' for i, (s, t) in enumerate(REPORT_SCOPES))}) AS v(section, scope, title)),
report_cells AS (SELECT section, position, max({METRIC_VALUE}) FILTER (WHERE model = 'base') AS base, max({METRIC_VALUE}) FILTER (WHERE model = 'tuned') AS tuned
  FROM positions, titles JOIN metrics ON metrics.scope = titles.scope GROUP BY section, position),
type_counts AS (SELECT section, titles.scope, title, max(n) AS n FROM titles JOIN metrics ON metrics.scope = titles.scope WHERE model = 'base' GROUP BY ALL),
texts AS (
  SELECT section, 0 AS nth, '' AS line FROM titles
  UNION ALL SELECT section, 1, '### ' || title || ' (n=' || n || ')' FROM type_counts
  UNION ALL SELECT section, 2, '| Metric | base | tuned |' FROM titles
  UNION ALL SELECT section, 3, '|--------|---|---|' FROM titles
  UNION ALL SELECT section, 10 + position + CASE WHEN position > 7 THEN 20 ELSE 0 END, '| ' || {LABEL_CASE} || ' | ' || CAST(base AS VARCHAR) || '% | ' || CAST(tuned AS VARCHAR) || '% |' FROM report_cells
  UNION ALL SELECT section, 20, '' FROM titles
  UNION ALL SELECT section, 21, '#### Field-Level F1 Breakdown' FROM titles
  UNION ALL SELECT section, 22, '| Field | base | tuned |' FROM titles
  UNION ALL SELECT section, 23, '|-------|---|---|' FROM titles
  UNION ALL SELECT 9, 0, ''
  UNION ALL SELECT 9, 1, 'Document type breakdown in held-out set: {{' || string_agg(chr(39) || scope || chr(39) || ': ' || n, ', ' ORDER BY section) || '}}' FROM type_counts WHERE section > 0)"""
HYBRID = ITEMS + ",\n" + CONTRACTS.removeprefix("WITH RECURSIVE ").replace("named AS (", "contract_names AS (").replace("JOIN named n", "JOIN contract_names n") + f""",
mixed AS (SELECT 'synthetic' AS source, report.example_id * 2 AS example_id, fx_examples.user_text FROM report JOIN fx_examples ON report.example_id = fx_examples.example_id
  UNION ALL SELECT 'real', row_id * 2 + 1, context FROM contracts),
dealt AS (SELECT *, {_tokens('user_text')} AS t, row_number() OVER (ORDER BY md5('42:' || CAST(example_id AS VARCHAR))) AS r, count(*) OVER () AS total FROM mixed),
parts AS (SELECT *, CASE WHEN r <= greatest(1, CAST(floor(total * 0.15::DOUBLE) AS BIGINT)) THEN 'eval' ELSE 'train' END AS part FROM dealt)"""

ORACLES: dict[str, str] = {
    "scan_jsonl": EX + " SELECT example_id, 3 AS n_messages, user_text, assistant_text FROM fx_examples",
    "scan_open_jsonl": EX + f""" SELECT CASE WHEN {BAD} IS NULL THEN example_id ELSE -1 END AS example_id, {BAD} IS NOT NULL AS own_id, {BAD} AS reason,
      CAST(CASE WHEN {BAD} IS NULL THEN 3 ELSE -1 END AS INT) AS n_messages, CASE WHEN {BAD} IS NULL THEN 'n' || example_id END AS note,
      CASE example_id % 50 WHEN 1 THEN left({LINE}, 40) WHEN 2 THEN {LINE} || ' {{}}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{{"messages": "none"}}' WHEN 5 THEN '{{"example_id": "x"}}' END AS bad_line
      FROM fx_examples WHERE example_id % 50 <> 6""",
    "clean_open_examples": ITEMS + f" SELECT e.example_id, CAST(3 AS INT) AS n_messages, 'n' || e.example_id AS note, e.user_text FROM fx_examples AS e JOIN report AS r ON r.example_id = e.example_id WHERE e.example_id % 50 NOT BETWEEN 1 AND 6",
    "split_from_files": "SELECT part, n, n AS with_text FROM (SELECT 'eval' AS part, greatest(1, CAST(floor(count(*) * 0.15) AS BIGINT)) AS n FROM orders UNION ALL SELECT 'train', count(*) - greatest(1, CAST(floor(count(*) * 0.15) AS BIGINT)) FROM orders) AS parts",
    "scan_qa": sql_prefix("fx_qa") + f" SELECT row_id, context, question, CAST(answer1 IS NOT NULL AS INT) + CAST(answer2 IS NOT NULL AS INT) AS n_answers, {FIRST_ANSWER} AS answer FROM fx_qa",
    "carve_payload": sql_prefix("fx_payload") + """ SELECT page_id,
      CASE WHEN strpos(body_text, '%PDF-') = 0 THEN NULL WHEN strpos(body_text, '%%EOF') = 0 THEN substr(body_text, strpos(body_text, '%PDF-'))
        ELSE substr(body_text, strpos(body_text, '%PDF-'), greatest(0, length(body_text) - strpos(reverse(body_text), 'FOE%%') + 2 - strpos(body_text, '%PDF-'))) END AS payload,
      CASE WHEN strpos(body_text, '%PDF-') = 0 THEN 'No valid PDF header found.' END AS error FROM fx_payload""",
    "doc_text": sql_prefix("fx_pages") + " SELECT doc_id, left(string_agg(text || chr(10), '' ORDER BY page_no), 3000) AS text FROM fx_pages GROUP BY doc_id",
    "assign_prompt": f"SELECT o_orderkey AS example_id, [{', '.join(lit(c) for c in CONTRACT_TYPES)}][{PICK}] AS contract_type, {lit(PROMPT_HEAD)} || [{', '.join(lit(c) for c in CONTRACT_TYPES)}][{PICK}] || {lit(PROMPT_TAIL + candidate_json_schema())} || chr(10) AS prompt FROM orders",
    "grounding_raw": EX + f" SELECT example_id, {grounded('v', 'src')} AS grounded FROM (SELECT example_id, lower(user_text) AS src, CASE example_id % 4 WHEN 0 THEN label_p1 WHEN 1 THEN 'Zyxwv Quorum' WHEN 2 THEN label_term || ' plus unknown' ELSE ' N/A ' END AS v FROM fx_examples) AS x",
    "validate_candidates": CAND + " SELECT example_id, attempt, reason IS NULL AS valid, reason FROM checked",
    "first_valid_attempt": CAND + f" SELECT example_id, attempt, json_extract_string(j, '$.messy_text') AS user_text, {_fields('j')}, json_extract_string(j, '$.extra') AS extra, false AS has_text FROM accepted",
    "stream_candidates": CAND + " SELECT example_id, attempt, json_extract_string(j, '$.messy_text') AS user_text, false AS modified FROM accepted",
    "truncate_context": "SELECT doc_id, CASE WHEN length(text) > 3500 THEN left(text, 3500) || '...' ELSE text END AS context, left(text, 3000) AS demo_text FROM documents",
    "route_questions": QA + " SELECT * FROM routed",
    "qa_to_contracts": CONTRACTS + " SELECT * FROM contracts",
    "mix_datasets": CONTRACTS.replace(sql_prefix("fx_qa"), sql_prefix("fx_qa", "fx_examples")) + f""" SELECT 'synthetic' AS source, example_id * 2 AS example_id, 3 AS n_messages, user_text, CASE WHEN json_valid(assistant_text) THEN json_extract_string(assistant_text, '$.effective_date') END AS effective_date FROM fx_examples
      UNION ALL SELECT 'real', row_id * 2 + 1, 3, context, effective_date FROM contracts""",
    "hybrid_pipeline": HYBRID + """ SELECT part, source, count(*) AS n, (list(t ORDER BY t))[count(*) // 2 + 1] AS p50, (list(t ORDER BY t))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
      max(t) AS max_tokens, count(*) FILTER (WHERE t > 100) AS over_limit FROM parts GROUP BY part, source""",
    "evaluation_prompts": SPLIT + f""" SELECT example_id, {HEAD['system']} || system_text || '{TURN_END}' || {HEAD['user']} || user_text || '{TURN_END}' || {HEAD['assistant']} AS prompt
      FROM fx_examples WHERE example_id IN (SELECT example_id FROM eval_ids)""",
    "build_examples": EX + " SELECT example_id, 0 AS pos, 'system' AS role, system_text AS content FROM fx_examples UNION ALL SELECT example_id, 1, 'user', user_text FROM fx_examples UNION ALL SELECT example_id, 2, 'assistant', assistant_text FROM fx_examples",
    "role_select": VARIED + f" SELECT example_id, found_at AS assistant_index, user_text, first_answer AS assistant_text, {py_text(valid_json('first_answer'), D)} AS effective_date FROM msgs",
    "prompt_messages": EX + " SELECT example_id, 0 AS pos, 'system' AS role, system_text AS content FROM fx_examples UNION ALL SELECT example_id, 1, 'user', user_text FROM fx_examples",
    "exclude_empty": LAB + " SELECT example_id, assistant_text FROM lab WHERE j IS NOT NULL AND len(json_keys(j)) > 0",
    "render_prompt": sql_prefix("fx_pages") + f" SELECT doc_id, page_no, {PROMPT.format('text')} AS prompt FROM fx_pages",
    "render_training": EX + f" SELECT example_id, {TRAINING} AS training_text FROM fx_examples",
    "doc_type": EX + f" SELECT example_id, {FILING} AS doc_type FROM fx_examples",
    "doc_type_counts": EX + f" SELECT t.doc_type, count(e.doc_type) AS n FROM (VALUES {', '.join(f'({lit(t)})' for t in DOC_TYPES)}) AS t(doc_type) LEFT JOIN (SELECT {FILING} AS doc_type FROM fx_examples) AS e ON t.doc_type = e.doc_type GROUP BY ALL",
    "flag_dates": LAB + f" SELECT example_id, {any_in(f'lower({D})', SUSPICIOUS_DATE_WORDS)} AS flagged FROM truth",
    "flag_truth": LAB + f" SELECT example_id, concat_ws('|', CASE WHEN {any_in(norm(D), SUSPICIOUS_DATE_WORDS)} THEN 'effective_date' END, CASE WHEN {any_in(f'lower({P})', SUSPICIOUS_PARTY_WORDS)} THEN 'parties' END) AS flags FROM truth",
    "stringify": LAB + f" SELECT example_id, {', '.join(FIELDS)} FROM truth",
    "clean_entries": ITEMS + " SELECT example_id, CAST(pos AS INT) AS pos, original, cleaned, reason FROM cleaned_items",
    "clean_parties": ITEMS + " SELECT example_id, array_to_string(kept, '|') AS kept, array_to_string(dropped, '|') AS dropped, CAST(len(pairs) AS INT) AS n_truncated FROM per_example",
    "clean_examples": ITEMS + f" SELECT example_id, modified, flagged AS effective_date_flagged, CASE WHEN NOT modified THEN {py_text('j', P)} WHEN json_type(j, '$.parties') = 'ARRAY' THEN {quoted_list('kept')} ELSE array_to_string(kept, ', ') END AS parties, {', '.join(f'{py_text('j', f)} AS {f}' for f in SCALAR_FIELDS)} FROM report",
    "cleaning_report": ITEMS + " SELECT example_index, example_id, array_to_string(dropped, '|') AS parties_dropped, array_to_string(pairs, '|') AS parties_truncated, flagged AS effective_date_flagged, modified FROM report WHERE modified OR flagged",
    "report_index": ITEMS + " SELECT example_id, example_index FROM report",
    "cleaning_summary": ITEMS + " SELECT count(*) AS survivors, CAST(count_if(modified) AS BIGINT) AS examples_modified, CAST(sum(len(dropped)) AS BIGINT) AS entries_dropped, CAST(sum(len(pairs)) AS BIGINT) AS entries_truncated, CAST(count_if(flagged) AS BIGINT) AS dates_flagged, (SELECT count(*) FROM fx_examples) - count(*) AS empties_excluded FROM report",
    "split_train": SPLIT + " SELECT example_id FROM ranked WHERE example_id NOT IN (SELECT example_id FROM eval_ids)",
    "split_eval": SPLIT + " SELECT example_id FROM eval_ids",
    "token_counts": sql_prefix("fx_pages") + f" SELECT doc_id, page_no, {_tokens('text')} AS tokens FROM fx_pages",
    "length_audit": _audit(f"SELECT {_tokens('text')} AS t FROM documents", 1536),
    "training_length_audit": EX + " " + _audit(f"SELECT {_tokens(TRAINING)} AS t FROM fx_examples", 100),
    "chunk_pages": CHUNKS + " SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk_text FROM chunks",
    "chunk_pages_blocked": CHUNKS + " SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk_text FROM chunks",
    "extract_chunks": CHUNKS + f" SELECT doc_id, 'Not Specified' AS effective_date, CAST(length({PROMPT.format('arg_min(chunk_text, chunk_no)')}) AS VARCHAR) AS liability_cap, 'Not Specified' AS termination_conditions FROM chunks GROUP BY doc_id",
    "extract_failures": CHUNKS + f""" SELECT doc_id, count(*) AS n_chunks, CAST(count_if(bad) AS BIGINT) AS n_failed,
      CASE WHEN NOT bool_or(bad) THEN 'ok' WHEN bool_and(bad) THEN 'failed' ELSE 'partial' END AS status, CASE WHEN bool_or(bad) THEN 'ValueError: bad length' END AS error
      FROM (SELECT doc_id, length({PROMPT.format('chunk_text')}) % 7 = 0 AS bad FROM chunks) AS c GROUP BY doc_id""",
    "first_json_object": OBJECTS + f" SELECT doc_id, chunk_no, j IS NOT NULL AS found, {_fields('j')} FROM objs",
    "merge_chunks": MERGED + f" SELECT doc_id, array_to_string(parties, '|') AS parties, {', '.join(SCALAR_FIELDS)} FROM merged",
    "display_defaults": MERGED + f" SELECT doc_id, coalesce(nullif(array_to_string(parties, ', '), ''), 'Not Specified') AS parties, {', '.join(f'''coalesce(nullif({f}, ''), 'Not Specified') AS {f}''' for f in SCALAR_FIELDS)} FROM merged",
    "route_input": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 AND text <> '' THEN left(text, 3000) WHEN doc_id % 3 = 1 AND doc_id % 5 <> 0 THEN left(text, 3000) END AS raw_text, CASE WHEN (doc_id % 3 = 0 AND doc_id % 4 <> 0 AND text <> '') OR (doc_id % 3 = 1 AND doc_id % 5 <> 0) THEN NULL ELSE 'Please provide either text or a PDF.' END AS error FROM documents",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS normal FROM documents",
    "normalize_date": EX + f" SELECT example_id, {iso_date('label_date')} AS iso FROM fx_examples",
    "split_parties": EX + f" SELECT example_id, array_to_string(list_sort({party_set(SPLIT_TEXT)}), '|') AS parties FROM fx_examples",
    "token_f1": PAIRED + f" SELECT model, example_id, round({scored(T, f'p_{T}', f't_{T}')}, 6) AS score FROM paired",
    "party_f1": PAIRED + f" SELECT model, example_id, round({scored(P, f'p_{P}', f't_{P}')}, 6) AS score FROM paired",
    "date_match": PAIRED + f" SELECT model, example_id, {scored(D, f'p_{D}', f't_{D}')} AS score FROM paired",
    "field_scores": SCORED + f" SELECT model, example_id, {', '.join(f'round(s_{f}, 6) AS {f}' for f in FIELDS)} FROM scored",
    "hallucination": SCORED + f" SELECT model, example_id, {', '.join(f'h_{f} AS {f}' for f in FIELDS)} FROM scored",
    "truncate_repetition": sql_prefix("fx_predictions") + f" SELECT p.model, p.example_id, CASE WHEN kind = 6 THEN CAST(length({LOOP_HEAD}) AS INT) ELSE -1 END AS loop_at, CASE WHEN kind = 6 THEN {LOOP_HEAD} ELSE output_text END AS kept_text FROM fx_predictions p JOIN fx_examples e ON e.example_id = p.example_id",
    "close_json": CLOSED + f" SELECT model, example_id, closed, {py_text(valid_json('closed'), C)} AS liability_cap FROM closings",
    "parse_outputs": PRED + f" SELECT model, example_id, {', '.join(FIELDS)}, parse_failed, was_truncated FROM parsed",
    "parse_or_error": sql_prefix("fx_predictions") + f", d AS (SELECT model, example_id, output_text, {valid_json(DEMO)} AS j FROM fx_predictions) SELECT model, example_id, {', '.join(f'CASE WHEN j IS NOT NULL THEN {py_text('j', f)} END AS {f}' for f in FIELDS)}, CASE WHEN j IS NULL THEN {NO_JSON} END AS error, CASE WHEN j IS NULL THEN output_text END AS raw_output FROM d",
    "unfence_outputs": sql_prefix("fx_predictions") + f" SELECT model, example_id, {BODY} AS body FROM fx_predictions",
    "align_predictions": sql_prefix("fx_predictions") + " SELECT p.model, p.example_id, p.output_text, e.user_text FROM fx_predictions p JOIN fx_examples e ON e.example_id = p.example_id",
    "parse_or_error_open": sql_prefix("fx_predictions") + f""", noted AS (SELECT model, example_id, replace(output_text, '"termination_conditions"', '"note": ["n' || example_id || '"], "termination_conditions"') AS output_text FROM fx_predictions),
      d AS (SELECT model, example_id, {valid_json(DEMO)} AS j FROM noted)
      SELECT model, example_id, CASE WHEN j IS NOT NULL THEN CAST(json_exists(j, '$.note') AS INT) ELSE -1 END AS n_other, CASE WHEN json_exists(j, '$.note') THEN '[' || chr(39) || 'n' || example_id || chr(39) || ']' ELSE '' END AS note,
      CASE WHEN j IS NOT NULL THEN {py_text('j', 'liability_cap')} END AS liability_cap, CASE WHEN j IS NULL THEN {NO_JSON} END AS error FROM d""",
    "evaluation_report": REPORT + " SELECT CAST(row_number() OVER (ORDER BY section, nth) - 1 AS INT) AS position, line FROM texts",
    "eval_metrics": METRICS + " SELECT * EXCLUDE (scope) FROM metrics WHERE scope = 'overall'",
    "metrics_by_type": METRICS + " SELECT * FROM metrics",
    "heldout_metrics": SPLIT.replace(EX, SCORED) + _metrics("example_id IN (SELECT example_id FROM eval_ids)") + " SELECT * FROM metrics",
    "metrics_table": TABLE + " SELECT CAST(position AS INT) AS position, metric, base, tuned FROM tab",
    "markdown_table": TABLE + f" SELECT CAST(position AS INT) AS position, '| ' || {LABEL_CASE} || ' | ' || CAST(base AS VARCHAR) || '% | ' || CAST(tuned AS VARCHAR) || '% |' AS line FROM tab",
    "metrics_json": METRICS + f""", recs AS (SELECT scope, '{{' || string_agg('"' || model || '":' || {JSON_RECORD}, ',' ORDER BY model) || '}}' AS r FROM metrics GROUP BY scope)
      SELECT '{{"overall":' || max(r) FILTER (WHERE scope = 'overall') || ',"by_document_type":{{"templated_synthetic":' || max(r) FILTER (WHERE scope = 'templated_synthetic') || ',"real_world_sec_style":' || max(r) FILTER (WHERE scope = 'real_world_sec_style') || '}}}}' AS metrics_json FROM recs""",
}
