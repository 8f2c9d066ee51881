"""Chat messages: building, picking by role, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import HEADER_END, HEADER_START, SERVING_SYSTEM, TRAINING_SYSTEM, TURN_END


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, assistant: Column, system: Column | None = None) -> Column:
    system = F.lit(TRAINING_SYSTEM) if system is None else system
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def first_of_role(messages: Column, role: str) -> Column:
    """Content of the first message of a role, NULL when there is none.

    The first three messages are looked at by compiled code; only beyond them the list is filtered.
    """
    found = F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]
    first, *others = [F.get(messages, i) for i in range(3)]
    early = F.when(first["role"] == role, first["content"])
    for other in others:
        early = early.when(other["role"] == role, other["content"])
    return early.otherwise(found)


def role_index(messages: Column, role: str) -> Column:
    """0-based position of the first message of a role, -1 when there is none."""
    roles = F.transform(messages, lambda m: m["role"])
    return (F.coalesce(F.array_position(roles, role), F.lit(0)) - 1).cast("int")


def without_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] != role)


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEADER_START), role, F.lit(HEADER_END))


def render_chat(messages: Column, add_reply_header: bool = False) -> Column:
    """The conversation as one training (or, with a reply header, prompting) string."""
    turns = F.transform(messages, lambda m: F.concat(_header(m["role"]), m["content"], F.lit(TURN_END)))
    text = F.array_join(turns, "")
    return F.concat(text, _header(F.lit("assistant"))) if add_reply_header else text


def render_prompt(document: Column, system_text: str = SERVING_SYSTEM) -> Column:
    """Single-turn extraction prompt around one chunk of document text."""
    return F.concat(
        _header(F.lit("system")), F.lit(system_text + TURN_END),
        _header(F.lit("user")), F.lit('Document text:\n"""\n'), document, F.lit('\n"""' + TURN_END),
        _header(F.lit("assistant")),
    )
