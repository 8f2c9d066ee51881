"""Declared schemas; nothing in the library infers one."""

MESSAGES = "array<struct<role:string,content:string>>"
EXAMPLE = f"example_id bigint, messages {MESSAGES}"
CANDIDATE = "example_id bigint, attempt int, raw_content string"
QA_ROW = "row_id bigint, context string, question string, answers struct<text:array<string>>"
PAGE = "doc_id bigint, page_no bigint, text string"
CHUNK_OUTPUT = "doc_id bigint, chunk_no bigint, output_text string"
PREDICTION = "model string, example_id bigint, output_text string"

# parties may be a list or a string and the other fields may hold any JSON value, hence variants
LABEL = (
    "parties variant, effective_date variant, liability_cap variant, "
    "termination_conditions variant, _corrupt_record string"
)
CANDIDATE_LABEL = "messy_text variant, " + LABEL
