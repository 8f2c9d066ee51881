"""JSON inside strings: strict and lenient object parsing, and values of unknown type as text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..rules import FIELDS
from .text import contains_any, count_of, let, strip_end

JSON_BLANKS = " \t\n\r"
CORRUPT = "_corrupt_record"
_PARSE_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}


def _label(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, _PARSE_OPTIONS)


def strict_label(text: Column, schema: str = schemas.LABEL) -> Column:
    """Parsed label, or NULL unless the whole text is exactly one JSON object.

    Spark's parsers ignore trailing text, so the text is parsed once, as the first entry of an array that a
    ``null`` ends: a text that holds more entries, or closes the array itself, has no ``null`` as its second
    and last one. A field whose own value is malformed (a key twice in an inner object) is missing. Only blanks before the brace are looked at: trimming both ends of a long text
    costs a pass over all of it. A text that ends with neither a brace nor a blank is no object; most cut off texts
    and those with words behind the object are told so, and not by an exception of the parser.
    """
    return let(_entries(text, schema), _only_entry)


def with_strict_label(rows: DataFrame, text: str, name: str, schema: str = schemas.LABEL) -> DataFrame:
    """Adds :func:`strict_label` of a column by projections of compiled code, which take the parsed entries once."""
    value, parsed = F.col(text), f"_entries_{name}"
    return (
        rows.withColumn(parsed, _entries(value, schema))
        .withColumn(name, _only_entry(F.col(parsed)))
        .drop(parsed)
    )


def _entries(text: Column, schema: str) -> Column:
    opens = F.startswith(F.ltrim(text, F.lit(JSON_BLANKS)), F.lit("{"))
    ends = functools.reduce(operator.or_, [F.endswith(text, F.lit(last)) for last in "}" + JSON_BLANKS])
    return F.from_json(
        F.when(opens & ends, F.concat(F.lit("["), text, F.lit(",null]"))),
        f"array<struct<{_fields(schema)}>>", _PARSE_OPTIONS,
    )


def _only_entry(parsed: Column) -> Column:
    return F.when((F.size(parsed) == 2) & F.get(parsed, F.lit(1)).isNull(), F.get(parsed, F.lit(0)))


def _fields(schema: str) -> str:
    """The fields of a label schema inside a struct; a nested struct has no place for the corrupt record."""
    named = (field.split() for field in schema.split(",") if CORRUPT not in field)
    return ", ".join(f"{name}: {kind}" for name, kind in named)


def first_object(text: Column, schema: str = schemas.LABEL) -> Column:
    """Parsed first JSON object in free text (fences removed, trailing text ignored), or NULL."""
    bare = F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    body = let(bare, lambda b: F.when(F.contains(b, F.lit("{")), F.substring(b, F.locate("{", b), F.length(b))))
    return let(_label(body, schema), lambda parsed: F.when(parsed["_corrupt_record"].isNull(), parsed))


def is_empty_object(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[ \t\n\r]*\{[ \t\n\r]*\}[ \t\n\r]*$"))


def close_truncated(text: Column) -> Column:
    """JSON text cut mid-way, trimmed back to its last complete pair and closed; NULL if hopeless.

    The cut is at the later of the last comma (dropped) and the last opening brace (kept). Open arrays
    are not repaired, so the result still has to pass :func:`strict_label`.
    """
    return let(let(strip_end(text), _complete_head), _closed)


def with_closed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds :func:`close_truncated` of a column by projections of compiled code."""
    value = F.col(name)
    body = rows.withColumn(name, strip_end(F.col(text)))
    return body.withColumn(name, _complete_head(value)).withColumn(name, _closed(value))


def _complete_head(body: Column) -> Column:
    cut = F.contains(body, F.lit(",")) | F.contains(body, F.lit("{"))
    return F.when(cut, F.regexp_extract(body, r"(?s)^.*(?:\{|(?=,))", 0))


def _closed(kept: Column) -> Column:
    quoted = F.concat(kept, F.when(count_of(kept, '"') % 2 == 1, F.lit('"')).otherwise(F.lit("")))
    return F.concat(strip_end(strip_end(quoted), ","), F.lit("}"))


def kind(value: Column) -> Column:
    """Type name of a variant: STRING, VOID (a JSON null), BOOLEAN, ARRAY<…>, OBJECT<…>, …"""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(kind(value), F.lit("ARRAY")), F.lit(False))


def as_text(value: Column) -> Column:
    """A variant as text: strings as they are, anything else as JSON; NULL and JSON null give NULL."""
    return F.try_variant_get(value, "$", "string")


def elements(value: Column) -> Column:
    """The entries of a list variant, each a variant; NULL for other types."""
    return F.try_variant_get(value, "$", "array<variant>")


def _python_quoted(text: Column) -> Column:
    return let(text, _quote)


def _quote(text: Column) -> Column:
    body = text
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(escaped))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _scalar_text(value: Column, type_name: Column) -> Column:
    return (
        F.when(type_name == "VOID", F.lit("None"))
        .when(type_name == "BOOLEAN", F.initcap(as_text(value)))
        .otherwise(as_text(value))
    )


def _element_text(value: Column) -> Column:
    return let(
        kind(value),
        lambda k: F.when(k == "STRING", _python_quoted(as_text(value))).otherwise(_scalar_text(value, k)),
    )


def stringify(value: Column) -> Column:
    """Python's ``str()`` of a JSON value; a missing value is the empty string.

    Lists print as ``['a', 'b']``. Objects and unusual numbers stay JSON text.
    """
    return let(value, lambda v: let(kind(v), lambda k: text_of_kind(v, k)))


def text_of_kind(value: Column, type_name: Column) -> Column:
    """:func:`stringify` for a value whose :func:`kind` is at hand, best as a column of an earlier projection."""
    printed = F.concat(
        F.lit("["), F.array_join(F.transform(elements(value), lambda e: _element_text(e)), ", "), F.lit("]")
    )
    return (
        F.when(type_name.isNull(), F.lit(""))
        .when(type_name == "STRING", as_text(value))
        .when(F.startswith(type_name, F.lit("ARRAY")), printed)
        .otherwise(_scalar_text(value, type_name))
    )


def with_field_texts(rows: DataFrame, label: str, prefix: str = "", fields: Iterable[str] = FIELDS) -> DataFrame:
    """Adds the label's fields as text columns ``<prefix><field>``; all empty when the label itself is NULL.

    The kinds are a projection of their own, so each is found once and the texts are compiled code. So are the
    entries of a list of texts, which is printed at once unless an entry has to be escaped.
    """
    kinds, lists = {f: f"_kind_{f}" for f in fields}, {f: f"_list_{f}" for f in fields}
    value = F.col(label)
    found = rows.withColumns({name: kind(value[f]) for f, name in kinds.items()}).withColumns({
        name: F.when(F.col(kinds[f]) == "ARRAY<STRING>", F.try_variant_get(value[f], "$", "array<string>"))
        for f, name in lists.items()
    })
    texts = {
        f"{prefix}{f}": F.when(_is_plain(F.col(lists[f])), _plain_list(F.col(lists[f])))
        .otherwise(text_of_kind(value[f], F.col(name)))
        for f, name in kinds.items()
    }
    return found.withColumns(texts).drop(*kinds.values(), *lists.values())


def _is_plain(entries: Column) -> Column:
    """Whether no entry of an array<string> is NULL (shown as a character to escape) or needs an escape."""
    return entries.isNotNull() & ~contains_any(F.array_join(entries, " ", "\\"), ("\\", "\n", "\r", "\t", "'"))


def _plain_list(entries: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(entries, "', '"), F.lit("']"))
