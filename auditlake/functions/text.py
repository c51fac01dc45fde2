"""Small text and number expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded in flat (regex) mode, in this order; &amp; goes last.
ENTITIES = [
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, so expression trees stay small."""
    return F.get(F.transform(F.array(value), body), 0)


def half_up(value: Column, digits: int) -> Column:
    """Half-up rounding on binary doubles (Spark's ``round`` goes through decimals)."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def collapse(text: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def snippet(html: Column, limit: int | None = None) -> Column:
    """Whitespace-collapsed markup (C12); a caller may cut it at ``limit`` characters, with a marker."""
    flat = F.regexp_replace(html, r"\s+", " ")
    if limit is None:
        return flat
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def capitalise(text: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)
