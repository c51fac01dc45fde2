"""Page markup to a flat start-tag stream with built-in regex expressions only (C1, flat).

No Python, no tree: each element carries its own leading text and nothing about
ancestors. Enough for outline, title, link and landmark checks, and it keeps
the markup inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, collapse, decode_entities

# What is removed before any tag is looked for, and the tag pattern.
NOISE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"<([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>([^<]*)"
ATTR = r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"


def _attributes(raw: Column) -> Column:
    """Attribute text to a map, first value of a repeated name kept."""

    def build(names: Column) -> Column:
        values = [F.regexp_extract_all(raw, F.lit(ATTR), F.lit(g)) for g in (2, 3, 4)]
        pairs = F.transform(
            F.arrays_zip(names.alias("k"), *[v.alias(f"v{i}") for i, v in enumerate(values)]),
            lambda z: F.named_struct(F.lit("k"), z["k"], F.lit("v"), decode_entities(F.concat(z["v0"], z["v1"], z["v2"]))),
        )
        return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))

    names = F.transform(F.regexp_extract_all(raw, F.lit(ATTR), F.lit(1)), F.lower)
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.trim(raw) == "", empty).otherwise(bind(names, build))


def element_stream(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """``pages(page_id, html)`` to ``(page_id, ordinal, tag, attrs, text, visible, selector)``.

    ``tags`` filters inside the array, before rows are made; tags are taken
    apart before the explode too, so later filters never repeat that work.
    """
    found = F.regexp_extract_all(F.regexp_replace("html", NOISE, ""), F.lit(TAG), F.lit(0))
    items = F.transform(found, lambda t, i: F.named_struct(F.lit("ordinal"), i, F.lit("raw"), t))
    if tags:
        wanted = r"(?i)^<(" + "|".join(tags) + r")(?![a-zA-Z0-9-])"
        items = F.filter(items, lambda x: x["raw"].rlike(wanted))

    def element(x: Column) -> Column:
        raw = x["raw"]
        return F.named_struct(
            F.lit("ordinal"), x["ordinal"],
            F.lit("tag"), F.lower(F.regexp_extract(raw, TAG, 1)),
            F.lit("attrs"), bind(F.regexp_extract(raw, TAG, 2), _attributes),
            F.lit("text"), collapse(decode_entities(F.regexp_extract(raw, TAG, 3))),
        )

    rows = pages.select("page_id", F.explode(F.transform(items, element)).alias("x"))
    return rows.select(
        "page_id", "x.ordinal", "x.tag", "x.attrs", "x.text", F.lit(True).alias("visible"), F.col("x.tag").alias("selector")
    )
