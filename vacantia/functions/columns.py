"""Small helpers shared by the column builders."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space or are trimmed in the source texts.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Lambdas of higher-order functions see their outer expressions again for every element;
    passing a costly one (``lower`` of a long text) through here avoids that.
    """
    return F.transform(F.array(value), body)[0]


# The same characters one by one, for the trim function.
_SPACE_CHARACTERS = "".join(
    map(
        chr,
        [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000, 0xFEFF],
    )
)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACE_CHARACTERS))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), rf"[{SPACE}]+", " ")


def blank_to_null(text: Column) -> Column:
    """Null for empty text, with the input evaluated once."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def present(text: Column) -> Column:
    """True when the text has something other than white space."""
    return F.coalesce(text.rlike(rf"[^{SPACE}]"), F.lit(False))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The capture group, or null where the pattern or the group took no part."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def join_present(sep: str, *parts: Column) -> Column:
    """Concatenate the parts that are neither null nor empty."""
    return F.concat_ws(sep, *[blank_to_null(p) for p in parts])


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def string_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def value_map(pairs: dict[str, str], key: Column) -> Column:
    """Look ``key`` up in a constant map."""
    literal = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(literal, key)


def sql_text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(names: Sequence[str], rows: Sequence[Sequence[str | None]]) -> Column:
    """A constant ``array<struct<...>>`` of strings; folded to one literal by the optimizer."""
    items = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {sql_text(v)}" for n, v in zip(names, row)) + ")"
        for row in rows
    )
    return F.expr(f"array({items})")


def quoted(phrase: str) -> str:
    """The phrase as a regular expression that matches it literally."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", phrase)
