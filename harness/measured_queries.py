"""Measurement tables derived from events, parts and customers (inventory G1-G16, A8, H4-H12)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from auditlake.operators import checks_measured as G
from auditlake.operators import evidence as H
from auditlake.sources import logs

from .core import block, derived, query, shared, table

shared(
    "focus_stop",
    """SELECT 'u' || CAST(user_id AS STRING) AS url, CAST(event_id AS INT) AS idx, event_type || CAST(event_id % 11 AS STRING) AS selector, 'main > ' || event_type AS component,
      'Voce ' || CAST(event_id % 13 AS STRING) AS label, 'a' AS tag, '<a>' AS html, value * 20 AS top, event_id % 9 <> 0 AS visible, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE 'solid' END AS outline_style,
      CASE WHEN event_id % 6 = 0 THEN '0px' ELSE '2px' END AS outline_width, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE '0 0 2px red' END AS box_shadow,
      CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE CAST(event_id % 7 - 3 AS STRING) END AS tabindex FROM {events}""",
)
block("visit", "SELECT *, row_number() OVER (PARTITION BY url, selector ORDER BY idx) AS n FROM focus_stop")
block("trap", "SELECT url, min(idx) AS trap_idx FROM visit WHERE n = 4 GROUP BY url")
block("live_stop", "SELECT s.*, idx = trap_idx AS is_trap FROM focus_stop s LEFT JOIN trap t USING (url) WHERE trap_idx IS NULL OR idx <= trap_idx")
block("walk_stop", "SELECT * FROM live_stop WHERE is_trap IS NULL OR NOT is_trap")


def stops(spark, sf):
    return derived(spark, sf, "focus_stop")


def keyboard(check):
    def run(spark, sf):
        customers = table(spark, sf, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("url"))
        pages = stops(spark, sf).select("url").unionByName(customers).dropDuplicates()
        return G.keyboard_checks(pages, stops(spark, sf)).filter(F.col("check_id") == check).select("url", "ordinal", "selector", "observation")

    return run


for name, check, sql in [
    ("g1_keyboard_trap", "keyboard-trap-suspected", "SELECT url, idx AS ordinal, selector, 'Con Tab il focus torna la quarta volta sullo stesso punto.' AS observation FROM live_stop WHERE is_trap"),
    ("g2_focus_on_hidden", "keyboard-focus-on-hidden", "SELECT url, idx AS ordinal, selector, 'Il focus sparisce su un elemento nascosto (a).' AS observation FROM walk_stop WHERE NOT visible"),
    (
        "g3_focus_not_visible",
        "focus-not-visible",
        """SELECT url, idx AS ordinal, selector, 'Nessun segno di focus su a "' || label || '".' AS observation FROM walk_stop
        WHERE visible AND (outline_style = 'none' OR outline_width = '0px') AND box_shadow IN ('', 'none')""",
    ),
    ("g4_positive_tabindex", "keyboard-positive-tabindex", """SELECT url, idx AS ordinal, selector, 'tabindex "' || tabindex || '" forza l''ordine.' AS observation FROM walk_stop WHERE tabindex::INTEGER > 0"""),
    (
        "g5_focus_order",
        "focus-order-suspicious",
        """SELECT url, 0 AS ordinal, 'body' AS selector, 'Il focus risale ' || count(*) || ' volte.' AS observation FROM (SELECT url, top, lag(top) OVER (PARTITION BY url ORDER BY idx) AS prev FROM walk_stop)
        WHERE top < prev - 80 GROUP BY url HAVING count(*) >= 3""",
    ),
    ("g6_no_focusable", "keyboard-no-focusable", "SELECT 'u' || c_custkey AS url, 0 AS ordinal, 'body' AS selector, 'Nessun elemento riceve il focus.' AS observation FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
]:
    query(name, sql)(keyboard(check))


@query("g7_tab_order", 'SELECT url, idx AS "index", selector, label, component FROM live_stop')
def _(spark, sf):
    return G.tab_order(stops(spark, sf))


@query("g7_whole_walk_previous", "SELECT url, idx, lag(top) OVER (PARTITION BY url ORDER BY idx) AS prev FROM focus_stop")
def _(spark, sf):
    return G.previous_value(stops(spark, sf).select("url", "idx", "top"), "url", "idx", "top", "prev", chunk=500).select("url", "idx", "prev")


shared(
    "colour_sample",
    """SELECT 'p' || CAST(p_size AS STRING) AS url, CAST(p_partkey AS INT) AS ordinal, 'a' || CAST(p_partkey AS STRING) AS selector, 'sig' || CAST(p_partkey % 17 AS STRING) AS signature, state,
      fr, fg, fb, fa, a1, a2, 'rgba(' || CAST(fr AS STRING) || ', ' || CAST(fg AS STRING) || ', ' || CAST(fb AS STRING) || CASE WHEN fa = 1 THEN ')' ELSE ', 0.5)' END AS color,
      CASE a1 WHEN 0 THEN 'rgba(0, 0, 0, 0)' WHEN 1 THEN 'rgb(' || CAST(p_partkey % 256 AS STRING) || ', 40, 90)' ELSE 'rgba(' || CAST(p_partkey % 256 AS STRING) || ', 40, 90, 0.5)' END
        || ';' || CASE a2 WHEN 0 THEN 'transparent' WHEN 1 THEN 'rgb(250, ' || CAST(p_partkey % 200 AS STRING) || ', 250)' ELSE 'rgba(250, ' || CAST(p_partkey % 200 AS STRING) || ', 250, 0.25)' END AS bg_text,
      p_partkey % 256 AS r1, p_partkey % 200 AS g2, CASE p_partkey % 3 WHEN 0 THEN 24.0E0 WHEN 1 THEN 18.66E0 ELSE 12.0E0 END AS font_size, CASE WHEN p_partkey % 2 = 0 THEN '700' ELSE '400' END AS font_weight, p_partkey % 10 = 0 AS painted
    FROM (SELECT *, 'rest' AS state, CAST(p_partkey * 7 % 256 AS INT) AS fr, CAST(p_partkey * 3 % 256 AS INT) AS fg, CAST(10 AS INT) AS fb, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS fa, p_partkey % 3 AS a1, CAST(floor(p_partkey / 3) AS BIGINT) % 3 AS a2 FROM {part}
      UNION ALL SELECT *, 'hover', CAST(p_partkey * 11 % 256 AS INT), CAST(p_partkey * 5 % 256 AS INT), CAST(200 AS INT), 1, p_partkey % 3, CAST(floor(p_partkey / 3) AS BIGINT) % 3 FROM {part})""",
)


def lum(r, g, b):
    def ch(v):
        return f"CASE WHEN ({v}) / 255.0::DOUBLE <= 0.03928 THEN ({v}) / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((({v}) / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"

    return f"(0.2126::DOUBLE * {ch(r)} + 0.7152::DOUBLE * {ch(g)} + 0.0722::DOUBLE * {ch(b)})"


block(
    "colour_bg",
    """SELECT *, CASE WHEN a1 = 1 THEN r1::DOUBLE WHEN a1 = 0 THEN CASE WHEN a2 = 1 THEN 250::DOUBLE ELSE 255 END WHEN a2 = 0 THEN 255 ELSE r1 * 0.5::DOUBLE + 250 * 0.5::DOUBLE END AS br,
      CASE WHEN a1 = 1 THEN 40::DOUBLE WHEN a1 = 0 THEN CASE WHEN a2 = 1 THEN g2::DOUBLE ELSE 255 END WHEN a2 = 0 THEN 255 ELSE 40 * 0.5::DOUBLE + g2 * 0.5::DOUBLE END AS bg,
      CASE WHEN a1 = 1 THEN 90::DOUBLE WHEN a1 = 0 THEN CASE WHEN a2 = 1 THEN 250::DOUBLE ELSE 255 END WHEN a2 = 0 THEN 255 ELSE 90 * 0.5::DOUBLE + 250 * 0.5::DOUBLE END AS bb FROM colour_sample""",
)
block(
    "colour_fg",
    """SELECT *, CASE WHEN fa = 1 THEN fr::DOUBLE ELSE fr * 0.5::DOUBLE + br * 0.5::DOUBLE END AS cr, CASE WHEN fa = 1 THEN fg::DOUBLE ELSE fg * 0.5::DOUBLE + bg * 0.5::DOUBLE END AS cg,
      CASE WHEN fa = 1 THEN fb::DOUBLE ELSE fb * 0.5::DOUBLE + bb * 0.5::DOUBLE END AS cb FROM colour_bg""",
)
block(
    "colour_ratio",
    f"""SELECT * EXCLUDE (l1, l2), floor((greatest(l1, l2) + 0.05::DOUBLE) / (least(l1, l2) + 0.05::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS ratio
    FROM (SELECT *, {lum("cr", "cg", "cb")} AS l1, {lum("br", "bg", "bb")} AS l2 FROM colour_fg)""",
)


def colours(spark, sf):
    return derived(spark, sf, "colour_sample").withColumn("bg_chain", F.split("bg_text", ";"))


@query("g8_contrast_ratio", "SELECT url, ordinal, state, ratio FROM colour_ratio")
def _(spark, sf):
    return G.with_contrast(colours(spark, sf)).select("url", "ordinal", "state", "ratio")


@query(
    "g9_hover_contrast",
    """SELECT url, ordinal, selector FROM (
      SELECT r.*, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY url, signature ORDER BY ordinal) AS s FROM (
          SELECT * FROM colour_ratio WHERE state = 'rest')) r WHERE s = 1) x
    JOIN (SELECT url, ordinal, ratio AS hover_ratio, color AS hover_color FROM colour_ratio WHERE state = 'hover') h USING (url, ordinal)
    WHERE NOT painted AND ratio >= 1.05 AND hover_color <> color
      AND hover_ratio < CASE WHEN font_size >= 24 OR (font_size >= 18.66::DOUBLE AND font_weight = '700') THEN 3 ELSE 4.5 END""",
)
def _(spark, sf):
    return G.hover_contrast_check(colours(spark, sf)).select("url", "ordinal", "selector")


shared(
    "layout_box",
    """SELECT 'p' || CAST(p_size AS STRING) AS url, CAST(320 AS INT) AS viewport, CAST(300 + p_size AS INT) AS doc_width, CAST(p_partkey AS INT) AS ordinal,
      CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey - p_partkey % 4 ELSE -1 END AS INT) AS parent, 'd' || CAST(p_partkey AS STRING) AS selector, 'sig' AS signature, 'div' AS tag, '<div>' AS html,
      CASE WHEN p_size IN (25, 35) THEN 200.0E0 ELSE p_partkey * 37 % 500 + 0.5E0 END AS right, p_partkey * 13 % 300 + 0.25E0 AS width, p_partkey % 11 <> 0 AS visible,
      CASE p_partkey % 5 WHEN 0 THEN 'hidden' WHEN 1 THEN 'clip' ELSE 'visible' END AS overflow, CASE WHEN p_partkey % 7 = 0 THEN 'hidden' ELSE 'visible' END AS overflow_y,
      CAST(p_partkey % 50 AS INT) AS text_length, CAST(100 + p_partkey % 23 AS INT) AS scroll_height, CAST(100 + p_partkey % 9 AS INT) AS client_height,
      CASE p_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'url(a.png)' ELSE 'linear-gradient(red, blue)' END AS background_image, p_partkey % 160 + 0.0E0 AS height FROM {part}""",
)
block("box_narrow", "SELECT * FROM layout_box WHERE doc_width - viewport > 2")
block(
    "box_outer",
    """SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS rn FROM box_narrow b WHERE visible AND "right" > viewport + 2 AND width > 40
      AND NOT EXISTS (SELECT 1 FROM box_narrow p WHERE p.url = b.url AND p.ordinal = b.parent AND p."right" > p.viewport + 2)""",
)


@query(
    "g10_reflow",
    """SELECT url, 'reflow-overflowing-element' AS check_id, ordinal, selector, 'A 320px div sporge di ' || (floor("right" + 0.5::DOUBLE)::INTEGER - viewport) || 'px.' AS observation FROM box_outer
    UNION ALL SELECT url, 'reflow-horizontal-scroll', 0, 'body', 'A 320px la pagina è larga ' || max(doc_width) || 'px.' FROM box_narrow WHERE url NOT IN (SELECT url FROM box_outer) GROUP BY url""",
)
def _(spark, sf):
    return G.reflow_checks(derived(spark, sf, "layout_box")).select("url", "check_id", "ordinal", "selector", "observation")


@query(
    "g11_text_spacing",
    """SELECT url, ordinal, selector, observation FROM (SELECT *, 'Testo alto ' || scroll_height || 'px tagliato a ' || client_height || 'px.' AS observation FROM layout_box
      WHERE (overflow IN ('hidden', 'clip') OR overflow_y = 'hidden') AND text_length > 20 AND scroll_height > client_height + 4)""",
)
def _(spark, sf):
    return G.spacing_check(derived(spark, sf, "layout_box")).select("url", "ordinal", "selector", "observation")


@query(
    "g12_background_images",
    """SELECT url, ordinal, selector FROM (SELECT * FROM layout_box WHERE visible AND background_image <> 'none' AND width > 200 AND height > 80)""",
)
def _(spark, sf):
    return G.background_check(derived(spark, sf, "layout_box")).select("url", "ordinal", "selector")


# one or two boxes per customer; the key picks the case
shared(
    "banner_box_raw",
    """SELECT 'c' || CAST(c_custkey AS STRING) AS url, CAST(1 AS INT) AS ordinal, CAST(1 AS INT) AS depth, '.box' AS selector,
      CASE c_custkey % 8 WHEN 0 THEN 'onetrust-banner-sdk' ELSE '' END AS element_id, CASE c_custkey % 8 WHEN 3 THEN 'cky-consent-container x' ELSE 'box' END AS class_text, '' AS test_id,
      c_custkey % 8 <> 3 AS shown, CASE WHEN c_custkey % 8 IN (1, 2, 4) THEN 'fixed' ELSE 'static' END AS position, 800.0E0 AS width, 90.0E0 AS height, CAST(CASE c_custkey % 8 WHEN 2 THEN 5 ELSE 100 END AS INT) AS z_index,
      CAST(1366 AS INT) AS viewport_width, 'Usiamo i Cookie' AS text, c_custkey % 5 = 0 AS aria_hidden_chain, c_custkey % 7 = 0 AS inert_chain, c_custkey % 3 <> 0 AS dismissed FROM {customer}
    UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 5, 1, '#didomi', 'didomi-host', 'box', '', true, 'static', 10.0E0, 10.0E0, 1, 1366, '', false, false, c_custkey % 9 <> 0 FROM {customer} WHERE c_custkey % 8 IN (4, 0)""",
)
# four controls per banner
shared(
    "banner_control",
    " UNION ALL ".join(
        f"""SELECT 'c' || CAST(c_custkey AS STRING) AS url, CAST(CASE WHEN c_custkey % 8 = 4 THEN 5 ELSE 1 END AS INT) AS banner_ordinal, CAST({k} AS INT) AS ordinal,
      CASE WHEN (c_custkey + {k}) % 4 = 0 THEN '-1' WHEN (c_custkey + {k}) % 4 = 1 THEN '0' ELSE CAST(NULL AS STRING) END AS tabindex, (c_custkey + {k}) % 3 = 0 AS disabled,
      (c_custkey % 6) * 10.0E0 AS width, 20.0E0 * (c_custkey % 6) AS height, c_custkey % 10 <> 1 AS shown, {label} AS aria_label, '' AS value, '{text}' AS text FROM {{customer}}"""
        for k, label, text in [
            (0, "' Accetta   tutti '", "Rifiuta"),
            (1, "CAST(NULL AS STRING)", "OK, ho capito!"),
            (2, "CAST(NULL AS STRING)", "Preferenze"),
            (3, "CAST(NULL AS STRING)", "Rifiuta"),
        ]
    ),
)


def boxes(spark, sf):
    return derived(spark, sf, "banner_box_raw").withColumn("classes", F.split("class_text", " "))


block(
    "banner",
    """SELECT 'c' || c_custkey AS url, c_custkey AS k, CASE WHEN c_custkey % 8 = 4 THEN 5 ELSE 1 END AS ordinal, CASE c_custkey % 8 WHEN 0 THEN 'OneTrust' WHEN 4 THEN 'Didomi' ELSE 'non identificata' END AS platform,
      CASE c_custkey % 8 WHEN 0 THEN '#onetrust-banner-sdk, #onetrust-consent-sdk' WHEN 4 THEN '#didomi-host, .didomi-popup-container' ELSE '.box' END AS container FROM customer WHERE c_custkey % 8 IN (0, 1, 4)""",
)


@query("g13_consent_banners", "SELECT url, ordinal, platform, container FROM banner")
def _(spark, sf):
    return G.consent_banners(boxes(spark, sf))


block(
    "banner_state",
    """SELECT b.*, bb.dismissed, NOT (bb.aria_hidden_chain OR bb.inert_chain) AND EXISTS (SELECT 1 FROM banner_control c WHERE c.url = b.url AND c.banner_ordinal = b.ordinal AND coalesce(c.tabindex, '0') <> '-1' AND NOT c.disabled AND c.width > 0 AND c.shown) AS reachable
    FROM banner b JOIN banner_box_raw bb ON bb.url = b.url AND bb.ordinal = b.ordinal""",
)


def reach(spark, sf):
    return G.banner_reachability(G.consent_banners(boxes(spark, sf)), boxes(spark, sf), derived(spark, sf, "banner_control"))


@query("g14_banner_reachability", "SELECT url, ordinal, platform, reachable FROM banner_state")
def _(spark, sf):
    return reach(spark, sf).select("url", "ordinal", "platform", "reachable")


@query("g14_unreachable_banners", "SELECT url, 'consent-not-keyboard-reachable' AS check_id, container AS selector FROM banner_state WHERE NOT reachable")
def _(spark, sf):
    return G.unreachable_banner_check(reach(spark, sf)).select("url", "check_id", "selector")


@query("g15_excluded_pages", "SELECT url, 'avviso sui cookie rimasto aperto (' || platform || ', selettore ' || container || '), pagina saltata' AS reason FROM banner_state WHERE NOT dismissed")
def _(spark, sf):
    ev = derived(spark, sf, "banner_control").withColumnRenamed("url", "page_url")
    return G.exclude_polluted(ev, reach(spark, sf))[1]


@query("g15_kept_evidence", "SELECT url AS page_url, count(*) AS n FROM banner_control WHERE url NOT IN (SELECT url FROM banner_state WHERE NOT dismissed) GROUP BY 1")
def _(spark, sf):
    ev = derived(spark, sf, "banner_control").withColumnRenamed("url", "page_url")
    return G.exclude_polluted(ev, reach(spark, sf))[0].groupBy("page_url").agg(F.count("*").alias("n"))


@query(
    "g16_accept_buttons",
    """SELECT url, ordinal, CASE ordinal WHEN 0 THEN 'Accetta tutti' WHEN 1 THEN 'OK, ho capito!' WHEN 2 THEN 'Preferenze' ELSE 'Rifiuta' END AS label, width > 0 AS visible, ordinal < 2 AND width > 0 AS accepts FROM banner_control""",
)
def _(spark, sf):
    return G.accept_candidates(derived(spark, sf, "banner_control")).select("url", "ordinal", "label", "visible", "accepts")


# ---------------------------------------------------------------- rule-engine log: one JSON line per customer page
NODE = '{"html":"<i>  N@ </i>","target":"main > a","failure_summary":"Fix\\n\\nthis","component_signature":"main > a","any":[{"id":"c","message":"MSG","data":"DATA"}]}'


def _rule_line(spark, sf):
    key = F.col("c_custkey")

    def node(i, message, data):
        text = F.lit(NODE.replace("DATA", json.dumps(data)[1:-1]))
        return F.replace(F.replace(text, F.lit("MSG"), message), F.lit("@"), F.lit(str(i)))

    contrast = '{"contrastRatio":3.1,"fgColor":"#777","bgColor":"#fff","fontSize":"12px","fontWeight":"bold","expectedContrastRatio":"4.5:1"}'
    overlap = F.when(key % 3 == 0, F.lit("Element is overlapped by another element")).otherwise(F.lit("background gradient"))
    undecided = F.concat(F.lit("["), F.concat_ws(",", *[F.when(key % 7 >= i, node(i, overlap if i % 2 == 0 else F.lit("contains an image node"), "{}")) for i in range(7)]), F.lit("]"))
    impact = F.when(key % 4 == 0, F.lit("null")).otherwise(F.lit('"serious"'))
    rule = F.when(key % 2 == 0, F.lit("color-contrast")).otherwise(F.lit("strange"))
    tags = F.when(key % 5 == 0, F.lit('["cat.color","wcag2aa","wcag143","wcag1410"]')).otherwise(F.lit("[]"))
    head = F.lit('"help":"Aiuto","description":"Ensure it","helpUrl":"https://r.example"')
    line = F.concat(
        F.lit('{"url":"https://c.example/'), key, F.lit('","violations":[{"id":"'), rule, F.lit('","impact":'), impact, F.lit(","), head, F.lit(',"tags":'), tags,
        F.lit(',"nodes":['), node(0, F.lit("m"), contrast), F.lit(']}],"incomplete":[{"id":"color-contrast","impact":null,'), head, F.lit(',"tags":["wcag143"],"nodes":'), undecided, F.lit("}]}"),
    )
    return table(spark, sf, "customer").select(line.alias("value"))


@query(
    "a8_rule_results",
    """SELECT 'https://c.example/' || c_custkey AS page_url, 'violation' AS outcome, CASE WHEN c_custkey % 2 = 0 THEN 'color-contrast' ELSE 'strange' END AS rule_id, 1 AS nodes FROM customer
    UNION ALL SELECT 'https://c.example/' || c_custkey, 'incomplete', 'color-contrast', (c_custkey % 7 + 1)::INTEGER FROM customer""",
)
def _(spark, sf):
    return logs.parse_rule_results(_rule_line(spark, sf)).select("page_url", "outcome", "rule_id", F.size("nodes").alias("nodes"))


@query(
    "h4_h7_rule_observations",
    """SELECT 'https://c.example/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'axe:color-contrast' ELSE 'axe:strange' END AS check_id, 0 AS ordinal,
      CASE WHEN c_custkey % 5 = 0 THEN '1.4.3 1.4.10' WHEN c_custkey % 2 = 0 THEN '1.4.3' ELSE '' END AS criteria, CASE WHEN c_custkey % 4 = 0 THEN 'moderate' ELSE 'serious' END AS engine_impact,
      CASE WHEN c_custkey % 2 = 0 THEN 'Contrasto 3.1:1 fra testo #777 e sfondo #fff, 12px, bold; soglia 4.5:1.' ELSE 'Aiuto. Fix this' END AS observation FROM customer
    UNION ALL SELECT 'https://c.example/' || c_custkey, 'axe-incomplete:color-contrast', i, '1.4.3', 'minor',
      'Contrasto non misurabile in automatico: va guardato a mano. (esito incerto: da guardare a mano).'
    FROM customer, (SELECT unnest(range(7))::INTEGER AS i) WHERE i <= c_custkey % 7 AND (i % 2 = 1 OR c_custkey % 3 <> 0)""",
)
def _(spark, sf):
    obs = H.rule_observations(logs.parse_rule_results(_rule_line(spark, sf)))
    return obs.select("url", "check_id", "ordinal", F.array_join("criteria", " ").alias("criteria"), "engine_impact", "observation")


@query("h12_rule_tally", "SELECT 'https://c.example/' || c_custkey AS url, (c_custkey % 7 + 1)::BIGINT AS incomplete_count FROM customer")
def _(spark, sf):
    return H.rule_tally(logs.parse_rule_results(_rule_line(spark, sf)))
