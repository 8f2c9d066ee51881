"""Fixed values and the user-overridable rule sets built from them.

Everything in the first half of this file is a value that decides results (phrase lists, patterns,
prompt texts, limits); it is stated once, here, and used by the column functions through
:class:`RuleSet`. Patterns are Java regular expressions; ``(?iU)`` gives case-insensitive matching with
Unicode-aware word boundaries.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

# ---- fixed values: label fields and chat constants -------------------------------------------------
FIELDS = ("parties", "effective_date", "liability_cap", "termination_conditions")
SCALAR_FIELDS = FIELDS[1:]
NOT_SPECIFIED = "Not Specified"
TRAINING_SYSTEM = "Extract JSON from legal text."
SERVING_SYSTEM = (
    "Extract structured legal metadata from text into a valid JSON object containing keys: "
    "'parties' (array), 'effective_date' (string), 'liability_cap' (string), and "
    "'termination_conditions' (string). Respond with raw JSON only."
)
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>\n\n"
TURN_END = "<|eot_id|>"

# ---- fixed values: limits --------------------------------------------------------------------------
QA_CONTEXT_CHARS = 3500
DEMO_TEXT_CHARS = 3000
MAX_ATTEMPTS = 5
EVAL_FRACTION = 0.15
SPLIT_SEED = 42
MAX_SEQ_TOKENS = 1536
PAGE_TOKEN_BUDGET = 4096 - 1024 - 100
GROUNDED_SHARE = 0.75
LOOP_MIN_LEN, LOOP_MAX_LEN, LOOP_STEP, LOOP_REPEATS = 25, 200, 5, 3

# ---- fixed values: generation prompt ---------------------------------------------------------------
CONTRACT_TYPES = (
    "Non-Disclosure Agreement (NDA)",
    "Commercial Lease Agreement",
    "Software as a Service (SaaS) Agreement",
    "Executive Employment Contract",
    "Vendor Service Level Agreement (SLA)",
    "Merger & Acquisition Letter of Intent",
    "Independent Contractor Agreement",
)
PROMPT_HEAD = "\nYou are a legal data generator. \nGenerate a messy, OCR-style contract excerpt from a "
PROMPT_TAIL = """.
The text must be realistically long (around 250 to 500 words). Include dense legal jargon, scanning errors, and typos.

Return ONLY a valid JSON object. 

CRITICAL QUALITY RULES:
1. The extracted fields MUST be exact substrings copied directly from the 'messy_text'.
2. Do not invent, summarize, or hallucinate information. If it is not explicitly in the text, use "Not Specified".

Schema: """
SCHEMA_DESCRIPTIONS = {
    "messy_text": "The heavily distorted, noisy raw legal text generated.",
    "parties": "The entities entering into the contract.",
    "effective_date": "The date the contract goes into effect.",
    "liability_cap": "The maximum financial liability mentioned.",
    "termination_conditions": "How the contract can be terminated.",
}

# ---- fixed values: null-like words, per stage (they differ on purpose) ------------------------------
CANDIDATE_NULLS = ("not specified", "none", "n/a", "")
EVALUATION_NULLS = ("not specified", "n/a", "")

# ---- fixed values: party entry rules ---------------------------------------------------------------
PARTY_LABELS = (
    "TENANT", "LANDLORD", "FIRST PARTY", "SECOND PARTY", "CLIENT", "VENDOR", "BUYER", "SELLER",
    "COMPANY NAME",
)
BOILERPLATE_PATTERNS = (
    r"\(hereinafter\b",
    r",\s*a\s+\w+\s+corporation\b",
    r",\s*a\s+\w+\s+limited liability company\b",
    r",\s*an?\s+individual\b",
    r",\s*a\s+company\b",
    r",\s*whose address\b",
    r"\bwith (its|his|her) principal place of business\b",
    r"\bresiding at\b",
    r"\ban entity with\b",
)
CLAUSE_PATTERNS = (
    r"\bshall\b", r"\bsubject to\b", r"\bpursuant to\b", r"\bin accordance with\b",
    r"\bmay terminate\b", r"\bagrees? to\b", r"\bwarrants?\b", r"\brepresents?\b",
    r"\bthe right to\b",
)
CLAUSE_LEAD_CHARS = 15
MAX_NAME_WORDS = 12
MIN_NAME_CHARS = 2

# ---- fixed values: flags and markers ---------------------------------------------------------------
SUSPICIOUS_DATE_WORDS = (
    "terminate", "termination", "renew", "notice", "shall be effective on", "in accordance with",
    "expiration",
)
SUSPICIOUS_PARTY_WORDS = (
    "tenant:", "landlord:", "address:", "hereinafter", "collectively", "individually", "shall have",
    "subject to",
)
FILING_MARKERS = (
    "exhibit 10", "securities and exchange commission", "confidential treatment", "sec ", "8-k",
    "10-k", "10-q", "certain identified information",
)
DOC_TYPES = ("templated_synthetic", "real_world_sec_style")

# ---- fixed values: question routing, first match wins ----------------------------------------------
QUESTION_ROUTES = (
    ("parties", "parties"),
    ("effective date", "effective_date"),
    ("liability cap", "liability_cap"),
    ("terminate", "termination_conditions"),
)

# ---- fixed values: report table labels -------------------------------------------------------------
METRIC_LABELS = (
    ("overall_f1", "**Overall F1 Score**"),
    ("exact_match_rate", "**Exact Match Rate**"),
    ("hallucination_rate", "**Hallucination Rate (all fields)**"),
    ("hallucination_rate_on_populated_fields", "**Hallucination Rate (populated fields only)**"),
    ("json_parse_failure_rate", "**JSON Parse Failure Rate**"),
    ("salvaged_via_truncation_rate", "**Salvaged via repetition-truncation**"),
    ("flagged_ground_truth_rate", "**Flagged (possibly mislabeled) ground truth**"),
)

# The printed report's wording.
REPORT_TITLES = (
    ("overall", "Overall Model Evaluation Results (blended)"),
    ("templated_synthetic", "Results on templated/synthetic documents only"),
    ("real_world_sec_style", "Results on real-world/SEC-filing-style documents only"),
)
REPORT_FIELDS_TITLE = "Field-Level F1 Breakdown"
REPORT_TYPES_LINE = "Document type breakdown in held-out set: "


def candidate_json_schema() -> str:
    """JSON schema of a candidate record, as printed at the end of the generation prompt."""
    props = {}
    for name, description in SCHEMA_DESCRIPTIONS.items():
        kind = {"items": {"type": "string"}} if name == "parties" else {}
        title = name.replace("_", " ").title()
        props[name] = {
            "description": description, **kind, "title": title,
            "type": "array" if name == "parties" else "string",
        }
    schema = {"properties": props, "required": list(props), "title": "ExtractionResult", "type": "object"}
    return json.dumps(schema, indent=2)


@dataclass(frozen=True)
class RuleSet:
    """The phrase lists a user may replace; the defaults are the fixed values above."""

    party_labels: tuple[str, ...] = PARTY_LABELS
    boilerplate: tuple[str, ...] = BOILERPLATE_PATTERNS
    clauses: tuple[str, ...] = CLAUSE_PATTERNS
    clause_lead_chars: int = CLAUSE_LEAD_CHARS
    max_name_words: int = MAX_NAME_WORDS
    min_name_chars: int = MIN_NAME_CHARS
    date_words: tuple[str, ...] = SUSPICIOUS_DATE_WORDS
    party_words: tuple[str, ...] = SUSPICIOUS_PARTY_WORDS
    filing_markers: tuple[str, ...] = FILING_MARKERS

    @property
    def label_regex(self) -> str:
        return r"(?iU)^\s*(" + "|".join(self.party_labels) + r")\s*:\s*"

    @property
    def boilerplate_regex(self) -> str:
        return "(?iU)" + "|".join(self.boilerplate)

    @property
    def clause_regex(self) -> str:
        return "(?iU)" + "|".join(self.clauses)


DEFAULT_RULES = RuleSet()
