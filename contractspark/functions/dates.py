"""Date normalisation without formatter exceptions: match the shape, assemble, try-cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_text, strip

MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
_NAME = "(" + "|".join(sorted({m for n in MONTHS for m in (n, n[:3])}, key=len, reverse=True)) + ")"
_DAY = r"(\d{1,2})"
_YEAR = r"(\d{4})"
_MONTH_FIRST = rf"(?i)^{_NAME}\s+{_DAY},?\s+{_YEAR}$"
_DAY_FIRST = rf"(?i)^{_DAY}\s+{_NAME}\s+{_YEAR}$"
_ISO = rf"^{_YEAR}-(\d{{1,2}})-( [1-9]|\d{{1,2}})$"
_SLASHES = rf"^(\d{{1,2}})/( [1-9]|\d{{1,2}})/{_YEAR}$"


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for x in (n[:3], str(i))])
    return F.try_element_at(table, F.lower(F.substring(name, 1, 3)))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, month, F.trim(day))
    return F.when(year != "0000", text.try_cast("date"))


def parse_date(text: Column) -> Column:
    """Date for the accepted spellings (month before day wins for slashes), else NULL.

    The shape decides which spelling is tried, so no attempt fails with an exception. Every spelling ends
    with a digit, so other texts are told by their last character.
    """
    return let(strip(text), parse_stripped)


def parse_stripped(t: Column) -> Column:
    """:func:`parse_date` of a stripped text at hand in a column."""
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    slash = [part(_SLASHES, i) for i in (1, 2, 3)]
    return (
        F.when(~F.substring(t, -1, 1).between("0", "9"), None)
        .when(F.rlike(t, F.lit(_ISO)), _date(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3)))
        .when(
            F.rlike(t, F.lit(_SLASHES)),
            F.coalesce(_date(slash[2], slash[0], slash[1]), _date(slash[2], slash[1], slash[0])),
        )
        .when(
            F.rlike(t, F.lit(_MONTH_FIRST)),
            _date(part(_MONTH_FIRST, 3), _month_number(part(_MONTH_FIRST, 1)), part(_MONTH_FIRST, 2)),
        )
        .when(
            F.rlike(t, F.lit(_DAY_FIRST)),
            _date(part(_DAY_FIRST, 3), _month_number(part(_DAY_FIRST, 2)), part(_DAY_FIRST, 1)),
        )
    )


def normalize_date(text: Column) -> Column:
    """ISO date when the text is a date, else the normalised text; blank and NULL give ''."""
    return F.coalesce(parse_date(text).cast("string"), normalize_text(text))
