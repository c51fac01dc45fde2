"""Checks decided from recorded measurement tables.

Focus walks, colour samples, boxes: a walk is an ordinary table here and may be
skewed, so nothing sorts a whole walk in one task. Running counts are cut to
the few rows that matter, and the previous-row comparison works on chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import colour
from ..functions.text import snippet
from .observations import measured, page_level, union

# Limits and thresholds.
MAX_VISITS = 3
BACKWARD_PX = 80
BACKWARD_JUMPS = 3
CHUNK = 4096
REST_FLOOR = 1.05
REFLOW_VIEWPORT = 320
REFLOW_SLACK = 2
REFLOW_WIDTH = 40
CLIP_SLACK = 4
CLIP_TEXT = 20
BANNER_TEXT = r"cookie|consenso|privacy|tracciamento|consent|gdpr"
ACCEPT_TEXT = (
    r"(?i)^(accetta(\s+(tutti|tutto|e chiudi|i cookie|tutti i cookie))?|acconsento|ho capito|va bene|consenti(\s+(tutti|tutto))?"
    r"|autorizzo|procedi|continua|chiudi|ok,?\s*(ho capito)?|accept(\s+(all|cookies|and close|all cookies))?|allow(\s+all)?|agree|i agree"
    r"|got it|understood|close|dismiss)[\s.!]*$"
)


def trap_stops(stops: DataFrame) -> DataFrame:
    """The stop that ends each walk, if any: the first fourth visit to one selector (G1).

    Only the first four visits of a selector are ranked; the rest of a hot
    selector is dropped before the shuffle.
    """
    order = Window.partitionBy("url", "selector").orderBy("idx")
    fourth = stops.select("url", "selector", "idx").withColumn("_rn", F.row_number().over(order))
    return (
        fourth.filter(F.col("_rn") <= MAX_VISITS + 1)
        .filter(F.col("_rn") == MAX_VISITS + 1)
        .groupBy("url")
        .agg(F.min("idx").alias("trap_idx"))
    )


def live_stops(stops: DataFrame) -> DataFrame:
    """Stops before the trap, with ``is_trap`` marking the trap itself."""
    cut = stops.join(trap_stops(stops), "url", "left")
    return cut.filter(F.col("trap_idx").isNull() | (F.col("idx") <= F.col("trap_idx"))).withColumn(
        "is_trap", F.coalesce(F.col("idx") == F.col("trap_idx"), F.lit(False))
    )


def previous_value(rows: DataFrame, key: str, order: str, value: str, out: str, chunk: int = CHUNK, levels: int = 2) -> DataFrame:
    """``lag(value)`` per key without sorting a whole key in one task.

    Inside a chunk of the order range it is a plain lag; the first row of a
    chunk takes the last value of the previous non-empty chunk. Those ends are
    found the same way, in chunks of chunks, so that a sparse order, where
    nearly every row is a chunk of its own, meets in no single task either.
    """
    chunked = rows.withColumn("_c", F.floor(F.col(order) / F.lit(chunk)))
    inner = Window.partitionBy(key, "_c").orderBy(order)
    lagged = chunked.withColumn("_in", F.lag(value).over(inner)).withColumn("_rn", F.row_number().over(inner))
    ends = chunked.groupBy(key, "_c").agg(F.max_by(value, order).alias("_end"))
    if levels > 1:
        ends = ends.withColumnRenamed("_c", "_at")
        before = previous_value(ends, key, "_at", "_end", "_before", chunk, levels - 1)
        carried = before.select(key, F.col("_at").alias("_c"), F.col("_before").alias("_carry"))
    else:
        carried = ends.select(key, "_c", F.lag("_end").over(Window.partitionBy(key).orderBy("_c")).alias("_carry"))
    return (
        lagged.join(carried, [key, "_c"])
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_in")))
        .drop("_c", "_in", "_rn", "_carry")
    )


def backward_jumps(stops: DataFrame) -> DataFrame:
    """Per page, how often the focus climbs by more than 80 px (G5); the trap stop does not count."""
    walk = live_stops(stops)
    stepped = previous_value(walk.filter(~F.col("is_trap")).select("url", "idx", "top"), "url", "idx", "top", "prev")
    jumps = stepped.groupBy("url").agg(F.count_if(F.col("top") < F.col("prev") - BACKWARD_PX).alias("jumps"))
    return jumps.join(walk.groupBy("url").agg(F.count("*").alias("stops")), "url")


def keyboard_checks(pages: DataFrame, stops: DataFrame) -> DataFrame:
    """G1-G6 on ``stops(url, idx, selector, component, label, tag, html, top, visible, outline_style, outline_width, box_shadow, tabindex)``."""
    rows = live_stops(stops).select("*", F.col("idx").alias("ordinal"), F.col("component").alias("signature"))
    trap = measured(
        rows.filter("is_trap"),
        "keyboard-trap-suspected",
        F.lit("Con Tab il focus torna la quarta volta sullo stesso punto."),
        {"repeats": F.lit(MAX_VISITS + 1), "label": F.col("label")},
        F.col("html"),
    )
    walked = rows.filter(~F.col("is_trap"))
    hidden = measured(
        walked.filter(~F.col("visible")),
        "keyboard-focus-on-hidden",
        F.concat(F.lit("Il focus sparisce su un elemento nascosto ("), F.col("tag"), F.lit(").")),
        {"label": F.col("label")},
        F.col("html"),
    )
    width = F.regexp_extract("outline_width", r"^\s*([0-9.]+)", 1).try_cast("double")
    no_outline = (F.col("outline_style") == "none") | (width == 0)
    no_shadow = F.coalesce(F.col("box_shadow"), F.lit("")).isin("", "none")
    unmarked = measured(
        walked.filter(F.col("visible") & F.coalesce(no_outline, F.lit(False)) & no_shadow),
        "focus-not-visible",
        F.concat(F.lit("Nessun segno di focus su "), F.col("tag"), F.lit(' "'), F.col("label"), F.lit('".')),
        {"outline": F.col("outline_style"), "boxShadow": F.col("box_shadow")},
        F.col("html"),
    )
    forced = measured(
        walked.filter(F.col("tabindex").try_cast("double") > 0),
        "keyboard-positive-tabindex",
        F.concat(F.lit('tabindex "'), F.col("tabindex"), F.lit('" forza l\'ordine.')),
        {"tabindex": F.col("tabindex")},
        F.col("html"),
    )
    jumps = backward_jumps(stops).filter(F.col("jumps") >= BACKWARD_JUMPS)
    climbing = page_level(
        jumps,
        "focus-order-suspicious",
        F.concat(F.lit("Il focus risale "), F.col("jumps").cast("string"), F.lit(" volte.")),
        {"backwardJumps": F.col("jumps"), "tabStops": F.col("stops")},
    )
    silent = page_level(
        pages.select("url").join(stops.select("url"), "url", "left_anti"),
        "keyboard-no-focusable",
        F.lit("Nessun elemento riceve il focus."),
    )
    return union(trap, hidden, unmarked, forced, climbing, silent)


def tab_order(stops: DataFrame, limit: int | None = None) -> DataFrame:
    """Stops of each walk, the trap included and nothing after it (G7); a caller may take the first ``limit`` (60 is usual)."""
    walk = live_stops(stops)
    if limit is not None:
        order = Window.partitionBy("url").orderBy("idx")
        walk = walk.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit)
    return walk.select("url", F.col("idx").alias("index"), "selector", "label", "component")


def with_contrast(samples: DataFrame) -> DataFrame:
    """Add ``ratio`` to ``(color, bg_chain)`` rows; null when the colour cannot be read."""
    return samples.withColumn("ratio", colour.text_contrast(F.col("color"), F.col("bg_chain")))


def hover_contrast_check(samples: DataFrame, candidates: int | None = None, signatures: int | None = None) -> DataFrame:
    """G9 on ``samples(url, ordinal, selector, signature, state, color, bg_chain, font_size, font_weight, painted)``.

    The first element of each signature of a page counts; each is a rest row and
    a hover row. A caller may look at the first ``candidates`` elements (40 is
    usual) and ``signatures`` (12 is usual) of a page only.
    """
    order = Window.partitionBy("url").orderBy("ordinal")
    rest_rows = samples.filter(F.col("state") == "rest")
    if candidates is not None:
        rest_rows = rest_rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= candidates).drop("_rn")
    chosen = rest_rows.withColumn("_s", F.row_number().over(Window.partitionBy("url", "signature").orderBy("ordinal"))).filter("_s = 1").drop("_s")
    if signatures is not None:
        chosen = chosen.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= signatures).drop("_k")
    rest = with_contrast(chosen).withColumnsRenamed({"ratio": "rest_ratio", "color": "rest_color"})
    hover = with_contrast(samples.filter(F.col("state") == "hover").select("url", "ordinal", "color", "bg_chain")).select(
        "url", "ordinal", F.col("ratio").alias("hover_ratio"), F.col("color").alias("hover_color")
    )
    large = (F.col("font_size") >= 24) | ((F.col("font_size") >= 18.66) & (F.col("font_weight").try_cast("double") >= 700))
    threshold = F.when(F.coalesce(large, F.lit(False)), F.lit(3.0)).otherwise(F.lit(4.5))
    bad = (
        rest.filter(~F.col("painted") & (F.col("rest_ratio") >= REST_FLOOR))
        .join(hover, ["url", "ordinal"])
        .withColumn("threshold", threshold)
        .filter((F.col("hover_ratio") < F.col("threshold")) & (F.col("hover_color") != F.col("rest_color")))
    )
    return measured(
        bad,
        "contrast-hover-insufficient",
        F.concat(F.lit("Al passaggio il contrasto è "), F.format_string("%.2f", "hover_ratio"), F.lit(":1, a riposo "), F.format_string("%.2f", "rest_ratio"), F.lit(":1.")),
        {
            "restRatio": F.col("rest_ratio"), "hoverRatio": F.col("hover_ratio"), "threshold": F.col("threshold"),
            "restColor": F.col("rest_color"), "hoverColor": F.col("hover_color"),
        },
    )


def reflow_checks(boxes: DataFrame) -> DataFrame:
    """G10 on ``boxes(url, viewport, doc_width, ordinal, parent, selector, signature, tag, html, right, width, visible)``."""
    limit = F.col("viewport") + REFLOW_SLACK
    narrow = boxes.filter((F.col("viewport") == REFLOW_VIEWPORT) & (F.col("doc_width") - F.col("viewport") > REFLOW_SLACK))
    wide = narrow.filter(F.col("right") > limit).select("url", F.col("ordinal").alias("parent"))
    outer = narrow.filter(F.col("visible") & (F.col("right") > limit) & (F.col("width") > REFLOW_WIDTH)).join(
        wide, ["url", "parent"], "left_anti"
    )
    def rounded(c: str) -> Column:
        return F.floor(F.col(c) + F.lit(0.5)).cast("int")

    over = rounded("right") - F.col("viewport")
    elements = measured(
        outer,
        "reflow-overflowing-element",
        F.concat(F.lit("A 320px "), F.col("tag"), F.lit(" sporge di "), over.cast("string"), F.lit("px.")),
        {"overflowPx": over, "elementWidth": rounded("width")},
        snippet(F.col("html")),
    )
    bare = narrow.groupBy("url").agg(F.max("doc_width").alias("doc_width"), F.max("viewport").alias("viewport")).join(outer.select("url"), "url", "left_anti")
    page = page_level(
        bare,
        "reflow-horizontal-scroll",
        F.concat(F.lit("A 320px la pagina è larga "), F.col("doc_width").cast("string"), F.lit("px.")),
        {"overflowPx": F.col("doc_width") - F.col("viewport")},
    )
    return union(page, elements)


def spacing_check(boxes: DataFrame) -> DataFrame:
    """G11 on ``boxes(url, ordinal, selector, signature, html, overflow, overflow_y, text_length, scroll_height, client_height)``."""
    hides = F.col("overflow").isin("hidden", "clip") | (F.col("overflow_y") == "hidden")
    cut = boxes.filter(hides & (F.col("text_length") > CLIP_TEXT) & (F.col("scroll_height") > F.col("client_height") + CLIP_SLACK))
    return measured(
        cut,
        "text-spacing-clipped",
        F.concat(F.lit("Testo alto "), F.col("scroll_height").cast("string"), F.lit("px tagliato a "), F.col("client_height").cast("string"), F.lit("px.")),
        {"scrollHeight": F.col("scroll_height"), "clientHeight": F.col("client_height")},
        snippet(F.col("html")),
    )


def background_check(boxes: DataFrame) -> DataFrame:
    """G12 on ``boxes(url, ordinal, selector, signature, html, background_image, width, height, visible)``."""
    painted = ~F.coalesce(F.col("background_image"), F.lit("")).isin("", "none")
    large = boxes.filter(F.col("visible") & painted & (F.col("width") > 200) & (F.col("height") > 80))
    return measured(
        large,
        "bg-image-review",
        F.lit("Sfondo figurato ampio: può contenere informazione."),
        {"backgroundImage": F.col("background_image")},
        snippet(F.col("html")),
    )


def consent_banners(boxes: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """The consent banner of each page: known platform first, else by look.

    ``boxes(url, ordinal, depth, selector, element_id, classes, test_id, shown,
    position, width, height, z_index, viewport_width, text, ...)``.
    """
    table = dims.or_own(platforms, dims.consent_platforms(boxes.sparkSession))

    def pair(attr: str, value: Column) -> Column:
        return F.struct(F.lit(attr).alias("attr"), value.alias("value"))

    tokens = F.concat(
        F.array(pair("id", F.col("element_id")), pair("data-testid", F.col("test_id"))), F.transform("classes", lambda c: pair("class", c))
    )
    known = (
        boxes.filter("shown")
        .select("url", "ordinal", F.explode(tokens).alias("t"))
        .select("url", "ordinal", "t.attr", "t.value")
        .join(table, ["attr", "value"])
        .groupBy("url")
        .agg(F.min(F.struct("platform_order", "ordinal", "platform", "container")).alias("k"))
        .select("url", F.col("k.ordinal").alias("ordinal"), F.col("k.platform").alias("platform"), F.col("k.container").alias("container"))
    )
    looks = (
        F.col("position").isin("fixed", "sticky")
        & F.col("shown")
        & (F.col("depth") <= 2)
        & (F.col("width") >= F.col("viewport_width") * 0.5)
        & (F.col("height") >= 60)
        & (F.coalesce("z_index", F.lit(0)) >= 10)
        & F.lower("text").rlike(BANNER_TEXT)
    )
    guessed = (
        boxes.filter(looks)
        .groupBy("url")
        .agg(F.min(F.struct("ordinal", "selector")).alias("g"))
        .join(known, "url", "left_anti")
        .select("url", F.col("g.ordinal").alias("ordinal"), F.lit("non identificata").alias("platform"), F.col("g.selector").alias("container"))
    )
    return known.unionByName(guessed)


def banner_reachability(banners: DataFrame, boxes: DataFrame, controls: DataFrame) -> DataFrame:
    """Can the banner be operated from the keyboard (G14): adds ``reachable``, ``dismissed``.

    ``controls(url, banner_ordinal, tabindex, disabled, width, height, shown)``.
    """
    state = boxes.select(
        "url", "ordinal", (F.col("aria_hidden_chain") | F.col("inert_chain")).alias("blocked"), "dismissed"
    )
    usable = (
        (F.coalesce(F.col("tabindex").try_cast("double"), F.lit(0.0)) >= 0)
        & ~F.col("disabled")
        & ((F.col("width") != 0) | (F.col("height") != 0))
        & F.col("shown")
    )
    live = controls.filter(usable).select("url", F.col("banner_ordinal").alias("ordinal"), F.lit(True).alias("live")).dropDuplicates()
    return (
        banners.join(state, ["url", "ordinal"])
        .join(live, ["url", "ordinal"], "left")
        .withColumn("reachable", ~F.col("blocked") & F.coalesce("live", F.lit(False)))
        .drop("blocked", "live")
    )


def unreachable_banner_check(reachability: DataFrame) -> DataFrame:
    """Observation on banners the keyboard cannot reach."""
    rows = reachability.filter(~F.col("reachable")).select("*", F.col("container").alias("selector"), F.lit("banner-consenso").alias("signature"))
    return measured(
        rows, "consent-not-keyboard-reachable", F.lit("L'avviso sui cookie non si raggiunge con Tab."), {"platform": F.col("platform")}
    )


def exclude_polluted(evidence: DataFrame, reachability: DataFrame, page_column: str = "page_url") -> tuple[DataFrame, DataFrame]:
    """Evidence without the pages whose banner stayed up, and those pages with a reason."""
    stuck = reachability.filter(~F.col("dismissed"))
    reason = F.concat(F.lit("avviso sui cookie rimasto aperto ("), "platform", F.lit(", selettore "), "container", F.lit("), pagina saltata"))
    kept = evidence.join(stuck.select(F.col("url").alias(page_column)).dropDuplicates(), page_column, "left_anti")
    return kept, stuck.select("url", reason.alias("reason"))


def accept_candidates(controls: DataFrame) -> DataFrame:
    """Clickable controls of a banner with their label and whether it reads like consent.

    ``controls(url, banner_ordinal, ordinal, aria_label, value, text, width, height)``.
    """
    raw = F.coalesce(F.nullif("aria_label", F.lit("")), F.nullif("value", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    label = F.trim(F.regexp_replace(raw, r"\s+", " "))
    seen = (F.col("width") > 0) & (F.col("height") > 0)
    return controls.select(
        "url", "banner_ordinal", "ordinal", label.alias("label"), seen.alias("visible"),
        (label.rlike(ACCEPT_TEXT) & (F.col("width") != 0) & (F.col("height") != 0)).alias("accepts"),
    )
