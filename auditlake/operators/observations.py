"""The observation row every check emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from .structure import css_path, signature_input

COLUMNS = [
    "url", "ordinal", "check_id", "criteria", "engine_impact", "selector", "component_signature", "html", "observation", "data",
]

# Criteria and impact of every own check.
CHECK_META = {
    "heading-no-h1": (("1.3.1", "2.4.6"), "serious"),
    "heading-multiple-h1": (("1.3.1",), "moderate"),
    "heading-skipped-level": (("1.3.1",), "moderate"),
    "heading-empty": (("1.3.1", "2.4.6"), "moderate"),
    "landmark-no-main": (("1.3.1", "2.4.1"), "serious"),
    "landmark-multiple-main": (("1.3.1",), "moderate"),
    "landmark-nav-unlabeled": (("1.3.1", "2.4.6"), "moderate"),
    "title-missing": (("2.4.2",), "serious"),
    "title-too-short": (("2.4.2",), "minor"),
    "skiplink-missing": (("2.4.1",), "moderate"),
    "img-empty-alt-in-link": (("1.1.1", "2.4.4"), "critical"),
    "img-empty-alt-review": (("1.1.1",), "minor"),
    "img-alt-is-filename": (("1.1.1",), "serious"),
    "img-alt-placeholder": (("1.1.1",), "serious"),
    "img-alt-too-long": (("1.1.1",), "minor"),
    "img-alt-duplicates-caption": (("1.1.1",), "minor"),
    "bg-image-review": (("1.1.1", "1.4.5"), "minor"),
    "link-generic-text": (("2.4.4",), "moderate"),
    "link-new-window-unannounced": (("3.2.1", "2.4.4"), "minor"),
    "link-raw-url-text": (("2.4.4",), "minor"),
    "link-same-text-different-targets": (("2.4.4",), "moderate"),
    "form-placeholder-as-label": (("3.3.2", "4.1.2"), "serious"),
    "form-required-not-indicated": (("3.3.2",), "minor"),
    "form-missing-autocomplete": (("1.3.5",), "moderate"),
    "form-radiogroup-no-fieldset": (("1.3.1", "3.3.2"), "moderate"),
    "form-search-no-submit": (("2.1.1",), "moderate"),
    "contrast-hover-insufficient": (("1.4.3",), "serious"),
    "reflow-horizontal-scroll": (("1.4.10",), "serious"),
    "reflow-overflowing-element": (("1.4.10",), "serious"),
    "text-spacing-clipped": (("1.4.12",), "moderate"),
    "keyboard-trap-suspected": (("2.1.2",), "critical"),
    "keyboard-focus-on-hidden": (("2.4.3", "2.4.7"), "serious"),
    "focus-not-visible": (("2.4.7",), "serious"),
    "keyboard-positive-tabindex": (("2.4.3",), "moderate"),
    "focus-order-suspicious": (("2.4.3", "1.3.2"), "moderate"),
    "keyboard-no-focusable": (("2.1.1",), "critical"),
    "consent-not-keyboard-reachable": (("2.1.1", "2.4.3"), "critical"),
}


def _meta(check_id: str) -> list[Column]:
    criteria, impact = CHECK_META[check_id]
    return [
        F.lit(check_id).alias("check_id"),
        F.array(*[F.lit(c) for c in criteria]).alias("criteria"),
        F.lit(impact).alias("engine_impact"),
    ]


def _json(data: dict[str, Column] | None) -> Column:
    if not data:
        return F.lit("{}")
    return F.to_json(F.named_struct(*[x for k, c in data.items() for x in (F.lit(k), c)]))


def page_level(rows: DataFrame, check_id: str, observation: Column, data=None, selector="body", ordinal=0, signature="document") -> DataFrame:
    """One observation about the page as a whole per row of ``rows(url, ...)``."""
    return rows.select(
        "url",
        F.lit(ordinal).cast("int").alias("ordinal"),
        *_meta(check_id),
        F.lit(selector).alias("selector"),
        F.lit(signature).alias("component_signature"),
        F.lit("").alias("html"),
        observation.alias("observation"),
        _json(data).alias("data"),
    )


def hit(check_id: str, when: Column, observation: Column, data=None) -> Column:
    """A possible observation on an element; null unless ``when`` holds."""
    criteria, impact = CHECK_META[check_id]
    return F.when(
        when,
        F.named_struct(
            F.lit("check_id"), F.lit(check_id),
            F.lit("criteria"), F.array(*[F.lit(c) for c in criteria]),
            F.lit("engine_impact"), F.lit(impact),
            F.lit("observation"), observation,
            F.lit("data"), _json(data),
        ),
    )


def on_elements(rows: DataFrame, hits: list[Column], chars: int | None = None) -> DataFrame:
    """Element rows to observations: all ``hits`` of a family in one pass.

    Selector and chain are built after the explode, so only for elements that
    hit; ``chars`` shortens their markup. The hits are exploded without a filter column in between: a filter
    would be pushed down and evaluate them twice.
    """
    tree = "lineage" in rows.columns
    located = rows.select(
        "url",
        "ordinal",
        (css_path() if tree else F.col("selector")).alias("selector"),
        (signature_input() if tree else F.lit("unknown")).alias("component_signature"),
        (snippet(F.col("html"), chars) if tree else F.lit("")).alias("html"),
        F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"),
    )
    return located.select("url", "ordinal", "h.check_id", "h.criteria", "h.engine_impact", "selector", "component_signature", "html", "h.observation", "h.data")


def measured(rows: DataFrame, check_id: str, observation: Column, data=None, html: Column | None = None) -> DataFrame:
    """Observation on rows of a measurement table with ``url, ordinal, selector, signature``."""
    return rows.select(
        "url",
        F.col("ordinal").cast("int").alias("ordinal"),
        *_meta(check_id),
        "selector",
        F.col("signature").alias("component_signature"),
        (html if html is not None else F.lit("")).alias("html"),
        observation.alias("observation"),
        _json(data).alias("data"),
    )


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out
